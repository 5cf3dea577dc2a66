"""Furrow: gridded land-use analytics and corpus preparation as Spark DataFrame jobs."""
