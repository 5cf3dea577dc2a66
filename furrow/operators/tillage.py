"""The tillage logic tree: six classes of area for each cell and crop, codes, groups and conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("conventional", "traditional_annual", "reduced", "conservation", "rotational", "traditional_rotational")


@dataclass(frozen=True)
class Rules:
    """Thresholds and variants of the tree over the columns annual, depth, field, high, area, ca."""

    field_threshold: float = 2.5
    flat: float = 15.0
    mid: float = 20.0
    #: Perennials of middle depth count in reduced twice, once as themselves and once in its shallow part.
    dedupe_shallow_perennials: bool = False
    drop_negative: bool = True

    def small(self):
        return F.coalesce(F.col("field") < self.field_threshold, F.lit(False))

    def large(self):
        return F.coalesce(F.col("field") >= self.field_threshold, F.lit(False))

    def is_flat(self):
        return F.coalesce(F.col("depth") < self.flat, F.lit(False))

    def is_mid(self):
        return F.coalesce((F.col("depth") >= self.flat) & (F.col("depth") < self.mid), F.lit(False))

    @staticmethod
    def rich():
        return F.col("high").isNotNull()

    def traditional_annual(self):
        """Annual crops on small fields outside flat soil and high income."""
        return F.when(F.col("annual") & ~self.is_flat() & self.small() & ~self.rich(), F.col("area"))

    def traditional_rotational(self):
        """The same for perennial crops; 0 as null."""
        return F.when(~F.col("annual") & ~self.is_flat() & self.small() & ~self.rich(), F.nullif(F.col("area"), F.lit(0.0)))

    def reduced_initial(self):
        """Every crop on flat soil."""
        return F.when(self.is_flat(), F.col("area"))

    def perennial_rest(self):
        """Perennial crops on large fields, or small ones in high income, outside flat soil."""
        return F.when(~F.col("annual") & ~self.is_flat() & (self.large() | (self.small() & self.rich())), F.col("area"))

    def rotational(self):
        """Those of them that aren't of middle depth."""
        return F.when(~self.is_mid(), F.nullif(self.perennial_rest(), F.lit(0.0)))

    def remainder(self):
        """What no class before has taken: the total less traditional, perennial, reduced and conservation area."""
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        left = F.col("area") - zero(self.traditional_annual()) - zero(self.traditional_rotational()) - zero(self.perennial_rest_used()) - zero(self.reduced_initial()) - zero(F.col("ca"))
        return F.when(left > 0, left) if self.drop_negative else F.nullif(left, F.lit(0.0))

    def perennial_rest_used(self):
        """The perennial area that the remainder gives off: only what stays rotational, unless shallow perennials count once."""
        return self.perennial_rest() if self.dedupe_shallow_perennials else self.rotational()

    def conventional(self):
        """The remainder outside middle depth, annual crops only."""
        return F.when(~self.is_mid() & F.col("annual"), self.remainder())

    def reduced(self):
        """Flat soil, the remainder of middle depth and perennials of middle depth; 0 as null."""
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return F.nullif(zero(self.reduced_initial()) + zero(F.when(self.is_mid(), self.remainder())) + zero(F.when(self.is_mid(), self.perennial_rest())), F.lit(0.0))


def tillage_inputs(cell_crop: DataFrame, cells: DataFrame, groups: DataFrame, ca: DataFrame, area: str = "ta") -> DataFrame:
    """One row for each cell and crop with all that the rules need."""
    joined = cell_crop.select("cell_id", "crop", F.col(area).alias("area")).join(F.broadcast(groups.select("crop", "annual")), "crop")
    joined = joined.join(cells.select("cell_id", "depth", "field", "high", "country_code"), "cell_id")
    return joined.join(ca.select("cell_id", "crop", F.col("allocated").alias("ca")), ["cell_id", "crop"], "left")


def tillage_classes(inputs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All six classes as columns of each cell and crop, in one pass."""
    return inputs.select(
        "cell_id", "crop", "country_code", "annual", "area", rules.conventional().alias("conventional"), rules.traditional_annual().alias("traditional_annual"), rules.reduced().alias("reduced"),
        F.nullif(F.col("ca"), F.lit(0.0)).alias("conservation"), rules.rotational().alias("rotational"), rules.traditional_rotational().alias("traditional_rotational"),
    )


def long_classes(classes: DataFrame) -> DataFrame:
    """(cell_id, crop, class, area) with only the areas that exist."""
    return classes.unpivot(["cell_id", "crop", "country_code"], list(CLASSES), "class", "class_area").filter("class_area IS NOT NULL")


def master_merge(classes: DataFrame) -> DataFrame:
    """The six classes summed over the crops of each cell; 0 as null, empty cells go."""
    out = classes.groupBy("cell_id").agg(*[F.nullif(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in CLASSES])
    return out.filter(F.coalesce(*CLASSES).isNotNull())


def category_code(scenario: str | None = None):
    """Code of a cell and crop: 4 conservation, 3 reduced, 2 traditional, 1 conventional of annual crops; 6, 5 of perennial ones; 7 for a scenario's area."""
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    annual = F.when(has("conservation"), 4).when(has("reduced"), 3).when(has("traditional_annual"), 2).when(has("conventional"), 1)
    code = F.when(F.col("annual"), annual).otherwise(F.when(has("traditional_rotational"), 6).when(has("rotational"), 5))
    return F.when(has(scenario), 7).otherwise(code) if scenario else code


def dominant_class(coded: DataFrame, by: str = "cell_id", code: str = "code") -> DataFrame:
    """The most frequent code of each cell, the smallest of equals."""
    counts = coded.filter(F.col(code).isNotNull()).groupBy(by, code).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(code, F.struct(-F.col("n"), F.col(code))).alias("dominant"))


def class_conflicts(coded: DataFrame, by: str = "cell_id", code: str = "code") -> DataFrame:
    """Cells with several codes: their number, the sorted codes, the winner and the crops that it overrides."""
    rows = coded.filter(F.col(code).isNotNull())
    seen = rows.groupBy(by).agg(F.array_sort(F.collect_set(code)).alias("codes")).filter(F.size("codes") > 1)
    win = rows.join(seen, by).join(dominant_class(coded, by, code), by)
    lost = F.array_sort(F.collect_set(F.when(F.col(code) != F.col("dominant"), F.col("crop"))))
    return win.groupBy(by).agg(F.size(F.first("codes")).alias("n_codes"), F.array_join(F.first("codes"), ",").alias("codes"), F.first("dominant").alias("winner"), F.array_join(lost, ",").alias("overridden"))


#: Six classes in three groups.
GROUPS = {"conservation": "conservation", "reduced": "conservation", "conventional": "conventional", "rotational": "conventional", "traditional_annual": "traditional", "traditional_rotational": "traditional"}


def group_classes(long: DataFrame, groups: dict[str, str] = GROUPS) -> DataFrame:
    """(cell_id, group, group_area): the six classes summed in three groups."""
    to = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return long.select("cell_id", to[F.col("class")].alias("class_group"), "class_area").groupBy("cell_id", "class_group").agg(F.sum("class_area").alias("group_area"))
