"""Dataset registry (X3): name -> file layout, read with the S1-S6 readers.

Every loader returns ``(ratings, items)``: ``ratings(user_id, item_id, rating, ts)``
and ``items(item_id, title[, year])``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmstart.sources import readers as rd


@dataclass(frozen=True)
class Layout:
    ratings: str
    ratings_sep: str
    ratings_header: bool
    items: str
    items_sep: str
    items_header: bool
    encoding: str = "UTF-8"
    sectioned: bool = False


# File names, separators, headers and encodings of the public rating dumps.
LAYOUTS = {
    "ml100k": Layout("u.data", "\t", False, "u.item", "|", False, "ISO-8859-1"),
    "ml1m": Layout("ratings.dat", "::", False, "movies.dat", "::", False, "ISO-8859-1"),
    "ml10m": Layout("ratings.dat", "::", False, "movies.dat", "::", False),
    "ml20m": Layout("ratings.csv", ",", True, "movies.csv", ",", True),
    "ml25m": Layout("ratings.csv", ",", True, "movies.csv", ",", True),
    "netflix": Layout("combined_data_*.txt", ",", False, "movie_titles.csv", ",", False, "ISO-8859-1", True),
    # one side of a user-disjoint split: the ratings file is named by the caller
    "split_csv": Layout("", ",", True, "movies.csv", ",", True),
    # both sides as ``writers.write_split`` stores them
    "split_sample": Layout("part=sample/*.csv", ",", True, "movies.csv", ",", True),
    "split_rest": Layout("part=rest/*.csv", ",", True, "movies.csv", ",", True),
}


def load_dataset(spark: SparkSession, name: str, root: str, ratings_file: str | None = None,
                 items_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Load a registered dataset from ``root``; unknown names raise ``ValueError``.

    ``ratings_file`` (with or without ``.csv``) and ``items_file`` replace the layout's file
    names. ``split_csv`` needs a ratings file: a sample and its complement lie in one folder
    and must never be read together."""
    key = name.lower()
    if key not in LAYOUTS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(LAYOUTS))}")
    lay = LAYOUTS[key]
    if ratings_file and lay.ratings_sep == "," and not ratings_file.endswith(".csv"):
        ratings_file += ".csv"
    lay = replace(lay, ratings=ratings_file or lay.ratings, items=items_file or lay.items)
    if not lay.ratings:
        raise ValueError(f"dataset {name!r} needs ratings_file")
    root = root.rstrip("/")
    if lay.sectioned:
        ratings = rd.read_sectioned_ratings(spark, f"{root}/{lay.ratings}")
        items = rd.read_titles_loose_csv(spark, f"{root}/{lay.items}", encoding=lay.encoding)
        return ratings, items
    ratings = rd.read_ratings(spark, f"{root}/{lay.ratings}", sep=lay.ratings_sep, header=lay.ratings_header)
    items = rd.read_items(spark, f"{root}/{lay.items}", sep=lay.items_sep, header=lay.items_header,
                          encoding=lay.encoding)
    return ratings, items.select("item_id", "title", F.lit(0).alias("year"))


def predefined_folds(spark: SparkSession, root: str) -> DataFrame:
    """The five pre-made ``u{k}.base``/``u{k}.test`` pairs of the 100k dump (S3)."""
    return rd.read_predefined_folds(spark, f"{root.rstrip('/')}/u[1-5].*")
