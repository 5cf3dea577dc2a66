"""Licence scan by template markup.

A template is licence text with marked regions: ``<<beginOptional>>`` ... ``<<endOptional>>`` may be absent, and
``<<var;match="...">>`` may be replaced. Templates are compiled to automata over tokens; a text holds a template
where the words between two places are accepted, so that all mandatory wording matches word for word. Plain
phrases (the base) are looked for as well.

Defined results: a null or empty text has no words and no label; overlapping places all count; repeated rows each
keep their row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from furrow.llm.batches import map_texts

#: Phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licence notices of a few words, with their optional and replaceable regions.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0",
    "cc-by": 'Licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY <<var;match="[0-9]+">>',
    "cc-by-nc": 'Licensed under <<beginOptional>>the<<endOptional>> CC BY-NC <<var;match="[0-9]+">>',
    "gpl-notice": "This <<var;match=\".{1,3}\">> is licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version <<var;match=\"[0-9]+\">>",
    "mit-notice": "Released under the MIT License",
    "copyright-line": 'Copyright <<beginOptional>>c<<endOptional>> <<var;match="[0-9]+">> <<var;match=".{1,6}">> All rights reserved',
}

#: Whole licence texts (MIT, ISC, two-clause BSD as the Open Source Initiative publishes them), from the grant to the end of the disclaimer.
TEXTS = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, '
        'fitness for a particular purpose and noninfringement. In no event shall <<var;match=".{1,12}">> be liable for any claim, damages or other '
        "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'The software is provided "as is" and <<var;match=".{1,12}">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. '
        'In no event shall <<var;match=".{1,12}">> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, '
        "data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        'This software is provided by <<var;match=".{1,12}">> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and '
        'fitness for a particular purpose are disclaimed. In no event shall <<var;match=".{1,12}">> be liable for any direct, indirect, incidental, special, exemplary, or consequential '
        "damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
        "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
    ),
}
TEMPLATES = NOTICES | TEXTS

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;(?:[^>"]|"[^"]*")*?match="([^"]*)"(?:[^>"]|"[^"]*")*?>>')


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters a-z, digits and anything beyond ASCII."""
    return WORD.findall(text.encode().lower()) if text else []


def parse(template: str) -> list:
    """Words as bytes, optional regions as lists, replaceable regions as (fewest words, most words or None, pattern of a word or None)."""
    stack: list[list] = [[]]
    at = 0
    for m in [*MARKUP.finditer(template), None]:
        stack[-1] += words_of(template[at : m.start() if m else len(template)])
        if m is None:
            break
        at = m.end()
        if m[0] == "<<beginOptional>>":
            stack.append([])
        elif m[0] == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that never began")
            inner = stack.pop()
            stack[-1].append(inner)
        elif b := re.fullmatch(r"\.\{(\d+),(\d*)\}", m[1]):
            stack[-1].append((int(b[1]), int(b[2]) if b[2] else None, None))
        else:
            stack[-1].append({".+": (1, None, None), ".*": (0, None, None)}.get(m[1]) or (1, 1, re.compile(m[1].encode())))
    if len(stack) > 1:
        raise ValueError("an optional region never ends")
    return stack[0]


class Automaton:
    """States with word edges, pattern edges and free moves; sets of states are merged to single states as they are met."""

    def __init__(self, templates: dict[str, str]):
        self.edges: list[list[tuple[object, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        starts = []
        for label, template in templates.items():
            first = self._state()
            last = self._build(parse(template), first)
            self.accepts[last] = label
            starts.append(first)
        self.start = self._closure(starts)
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}
        #: Words that any template can begin with; None if some template begins with a replaceable region.
        firsts = {on for s in self.start for on, _ in self.edges[s]}
        self.first_words = None if any(not isinstance(f, bytes) for f in firsts) else firsts

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = self._state()
                self.edges[at].append((part, to))
            elif isinstance(part, list):
                end = self._build(part, at)
                to = self._state()
                self.free[end].append(to)
                self.free[at].append(to)
            else:
                least, most, pattern = part
                to = self._state()
                here = at
                for _ in range(least):
                    nxt = self._state()
                    self.edges[here].append((pattern, nxt))
                    here = nxt
                self.free[here].append(to)
                if most is None:
                    loop = self._state()
                    self.free[here].append(loop)
                    self.edges[loop].append((pattern, loop))
                    self.free[loop].append(to)
                for _ in range((most or 0) - least):
                    nxt = self._state()
                    self.edges[here].append((pattern, nxt))
                    self.free[nxt].append(to)
                    here = nxt
            at = to
        return at

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        got = self.known.get((states, word))
        if got is None:
            got = self._closure([to for s in states for on, to in self.edges[s] if on is None or on == word or (isinstance(on, re.Pattern) and on.fullmatch(word))])
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[states, word] = got
        return got

    def labels(self, words: list[bytes]) -> dict[str, tuple[int, int]]:
        """For each template accepted somewhere, the first place: (first word, word after the last)."""
        found: dict[str, tuple[int, int]] = {}
        places = range(len(words)) if self.first_words is None else [k for k, w in enumerate(words) if w in self.first_words]
        for k in places:
            states = self.start
            for j in range(k, len(words)):
                states = self.step(states, words[j])
                if not states:
                    break
                for s in states:
                    if s in self.accepts:
                        found.setdefault(self.accepts[s], (k, j + 1))
        return found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,first_word:long,end_word:long>>"


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for each row.

    ``score``: 1 if the whole mandatory wording of a licence text is there, 0.75 if only that of a notice is, 0.5 if only a phrase is, else 0. ``places``: the first accepted
    place of each template.
    """
    phrases, whole = [(words_of(p), label) for p, label in base.items()], set(texts)

    def make():
        automaton = Automaton(notices | texts)
        firsts: dict[bytes, list] = {}
        for phrase, label in phrases:
            firsts.setdefault(phrase[0], []).append((phrase, label))
        starts = None if automaton.first_words is None else automaton.first_words

        def scan(texts: list[str | None]) -> list:
            rows = []
            for t in texts:
                words = words_of(t)
                have = set(words)
                at, labels = [], set()
                if not have.isdisjoint(firsts):
                    for k, w in enumerate(words):
                        for phrase, label in firsts.get(w, ()):
                            if words[k : k + len(phrase)] == phrase:
                                at.append(k)
                                labels.add(label)
                found = automaton.labels(words) if starts is None or not have.isdisjoint(starts) else {}
                both = labels | set(found)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), 1.0 if not whole.isdisjoint(found) else 0.75 if found else 0.5 if labels else 0.0,
                             [{"label": x, "first_word": a, "end_word": b} for x, (a, b) in sorted(found.items())]))
            return [list(column) for column in zip(*rows)]

        return scan

    return map_texts(docs.select(id, text), text, SCHEMA, make)


def template_regex(template: str) -> str:
    """The same template as a regular expression over words that each are followed by one space, for checks in SQL."""

    def part(x) -> str:
        if isinstance(x, bytes):
            return x.decode() + " "
        if isinstance(x, list):
            return "(?:" + "".join(map(part, x)) + ")?"
        least, most, pattern = x
        return f"(?:{pattern.pattern.decode() if pattern else '[^ ]+'} ){{{least},{'' if most is None else most}}}"

    return " " + "".join(map(part, parse(template)))
