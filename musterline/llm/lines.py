"""Line dedup by winnowing over line hashes.

Lines that are not blank are hashed. Windows start at each of them: one of ``RUN`` lines, and a shorter one where fewer
lines have more than ``WORDS`` words, for a passage of that many words counts as a run even if it is one line. Each window keeps its smallest hash as its fingerprint, so every repeated run that holds a window has a
common fingerprint. Fingerprints that stand at one place only are dropped; the windows of the others are compared
with the earliest equal window of the corpus. Overlapping matches join, which extends a match both ways as far as
windows go, and the later occurrence of a run is deleted with the blank lines inside it. A text of fewer lines is
one window of its own length and is compared with texts of as many.

Places are ordered by doc_id (null last), then by a hash of the row, then by line; the earliest
occurrence stays. Defined results: a null text stays null, a text without lines that are not blank stays as
it is, a text all of whose lines are repeats becomes empty. Rows equal in id and text stand at
the same place, so neither is a repeat of the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage
from musterline.llm.tables import row_key

RUN = 3
WORDS = 50
KEY = ["_k1", "_k2"]


def _kept_lines(text: Column) -> Column:
    """The lines that are not blank, as (hash, words, place)."""
    blank = " \t\r"
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line, i: F.struct(
            F.when(F.btrim(line, F.lit(blank)) != "", F.xxhash64(line)).alias("h"),
            F.regexp_count(line, F.lit("[^ \\t\\r]+")).alias("words"),
            i.alias("at"),
        ),
    )
    return F.filter(lines, lambda s: s["h"].isNotNull())


def windows(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(_k1, _k2, doc_id, first, last, fingerprint, size, h0, h1, ...) of every window of every row."""
    rows = documents.select(*row_key("doc_id", "text"), "doc_id", _kept_lines(F.col("text")).alias("kept"))
    many = F.size("kept")

    def window(i, size):
        here = [F.get(F.col("kept"), i + j) for j in range(run)]
        inside = [size > j for j in range(run)]
        last = F.get(F.col("kept"), i + size - 1)["at"]
        hashes = [F.when(t, x["h"]).otherwise(F.lit(0)).alias(f"h{j}") for j, (t, x) in enumerate(zip(inside, here))]
        least = F.least(*[F.when(t, x["h"]) for t, x in zip(inside, here)]) if run > 1 else here[0]["h"]
        whole = F.struct(here[0]["at"].alias("first"), last.alias("last"), least.alias("fingerprint"), size.alias("size"), *hashes)
        return F.when(i + size <= many, whole)  # null beyond the end, and for a null size

    def of_lines(_, i):
        return window(i, F.when(i == 0, F.least(many, F.lit(run))).otherwise(F.lit(run)))

    def of_words(_, i):
        words, sizes = F.lit(0), []
        for j in range(run - 1):
            words = words + F.get(F.col("kept"), i + j)["words"]
            sizes.append(F.when(words > WORDS, F.lit(j + 1)))  # null words, beyond the end, are no bound
        return window(i, F.coalesce(*sizes))

    windows_of = [F.transform("kept", of_lines)] + ([F.transform("kept", of_words)] if run > 1 else [])
    starts = F.array_compact(F.concat(*windows_of))
    found = rows.select(*KEY, "doc_id", F.explode(starts).alias("_w"))
    return found.select(*KEY, "doc_id", "_w.*")


def repeated_runs(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(_k1, _k2, runs): for each row with lines to delete, their runs as (first, last), in order."""
    found = cut_lineage(windows(documents, run))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *KEY, "first")
    many = found.count()
    prints = found.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    # Tables of their own, as only a join of two plain shuffles has its hot keys split.
    repeated = cut_lineage(prints.filter("low <> high").select("fingerprint"), many)
    same = ["size", *[f"h{j}" for j in range(run)]]
    open_ = cut_lineage(found.join(repeated, "fingerprint", "left_semi").drop("fingerprint"))
    earliest = open_.groupBy(*same).agg(F.min(place).alias("_earliest"), F.max(place).alias("_latest"))
    earliest = cut_lineage(earliest.filter("_earliest <> _latest").drop("_latest"), many)
    later = open_.join(earliest, same).filter(place > F.col("_earliest"))
    spans = later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    return spans.select(*KEY, _joined("spans").alias("runs"))


def _joined(spans: str) -> Column:
    """Sorted spans with those joined that overlap or touch."""

    @F.pandas_udf("array<struct<first: int, last: int>>")
    def join(all_spans: pd.Series) -> pd.Series:
        out = []
        for own in all_spans:
            runs: list[dict] = []
            for span in own:
                if runs and span["first"] <= runs[-1]["last"] + 1:
                    runs[-1]["last"] = max(runs[-1]["last"], span["last"])
                else:
                    runs.append({"first": int(span["first"]), "last": int(span["last"])})
            out.append(runs)
        return pd.Series(out)

    return join(F.col(spans))


def _cut(text: Column, runs: Column) -> Column:
    """The text without the lines of its runs; null where either is null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_runs: pd.Series) -> pd.Series:
        out = []
        for whole, own in zip(texts, all_runs):
            if whole is None or own is None:
                out.append(None)
                continue
            lines, kept, at = whole.split("\n"), [], 0
            for run in own:
                kept += lines[at : run["first"]]
                at = run["last"] + 1
            out.append("\n".join(kept + lines[at:]))
        return pd.Series(out, dtype=object)

    return cut(text, runs)


def without_repeats(documents: DataFrame, run: int = RUN) -> DataFrame:
    """``documents`` with later repeated runs of lines deleted from ``text``; beside it the ``original`` text
    and the deleted ``runs`` of lines (null where nothing was deleted)."""
    columns = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    keyed = documents.select(*row_key("doc_id", "text"), row)
    joined = keyed.join(repeated_runs(documents, run), KEY, "left")
    changed = F.col("runs").isNotNull()
    cut = _cut(F.when(changed, F.col("_row.text")), F.col("runs"))
    joined = joined.withColumn("_cut", cut)
    text = F.when(changed, F.col("_cut")).otherwise(F.col("_row.text"))
    kept = [(text if c == "text" else F.col("_row")[c]).alias(c) for c in columns]
    return joined.select(*kept, F.col("_row.text").alias("original"), "runs")


def deduplicated(documents: DataFrame, run: int = RUN) -> DataFrame:
    """``documents`` with repeated runs deleted and n_chars renewed; what has lost all its lines goes."""
    columns = documents.columns
    rows = without_repeats(documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), "doc_id", "text"), run)
    rows = rows.filter(F.col("runs").isNull() | (F.col("text") != ""))
    count = F.when(F.col("runs").isNull(), F.col("_all")["n_chars"]) if "n_chars" in columns else None
    kept = []
    for c in columns:
        if c == "text":
            kept.append(F.col("text").alias(c))
        elif c == "n_chars":
            kept.append(count.otherwise(F.char_length("text")).cast(documents.schema[c].dataType).alias(c))
        else:
            kept.append(F.col("_all")[c].alias(c))
    return rows.select(*kept)
