"""Repeated runs of lines, found by winnowing over line hashes and deleted after their first occurrence.

Lines are the \\n-separated parts of a text that have a word; they are compared without outer white space.  A *window*
starts at a line and takes as many lines as it needs to hold ``min_words`` words (a line is at least one word, so never
more than that many lines).  Each window selects its line of least hash, the first of equals; neighbouring windows
mostly select the same line, so there are fewer fingerprints than lines.  Every repeated run of ``min_words`` words
holds a whole window and so shares a fingerprint with its other occurrences.  Fingerprints that occur once are dropped;
around the others, all windows that selected them are compared, which extends each match both ways to its full length.
A window that already occurred, in the order of (document id, hash of the text, place), is deleted with what lies
between its lines; its first occurrence stays.

Defined cases: a null text is an empty one and stays null; rows with a null id come after all others in the order of
first occurrence; repeated rows (same id and text) count as one document and are treated alike; an empty table gives an
empty result; other columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import SPACE, checkpointed, fresh

#: Words that a repeated run must have.
MIN_WORDS = 40
BLANKS = " \t\n\x0b\f\r"


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _windows(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """(id, th, p_hash, at, ctx, n): a row per fingerprint; ctx holds the lines (hash, words) of the n windows, from
    line number ``at`` on, that selected it."""
    c = F.col
    df = docs.select(c(id_col).alias("id"), c(text).alias("t")).where(c("t").isNotNull())
    df = df.select("id", F.xxhash64("t").alias("th"), F.filter(F.split("t", "\n"), _has_word).alias("raw"))
    df = df.select(
        "id",
        "th",
        F.transform(
            c("raw"),
            lambda x: F.struct(
                F.xxhash64(F.btrim(x, F.lit(BLANKS))).alias("h"),
                F.size(F.split(F.btrim(x, F.lit(BLANKS)), SPACE)).alias("w"),
            ),
        ).alias("lines"),
    )

    start = F.struct(
        F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("k")
    )

    def step(a: Column, line: Column) -> Column:
        less = a["h"].isNull() | (line["h"] < a["h"])
        return F.when(a["words"] >= min_words, a).otherwise(
            F.struct(
                (a["words"] + line["w"]).alias("words"),
                (a["n"] + 1).alias("n"),
                F.when(less, line["h"]).otherwise(a["h"]).alias("h"),
                F.when(less, a["n"]).otherwise(a["k"]).alias("k"),
            )
        )

    def window(_: Column, i: Column) -> Column:
        """n: lines of the window that starts at line i (null if the text ends before); p: the line it selects."""
        found = F.aggregate(F.slice(c("lines"), i + 1, F.lit(min_words)), start, step)
        return F.transform(
            F.array(found),
            lambda a: F.struct(F.when(a["words"] >= min_words, a["n"]).alias("n"), (i + a["k"]).alias("p")),
        )[0]

    df = df.withColumn("wins", F.transform(c("lines"), window))
    df = df.withColumn("wins", F.filter(c("wins"), lambda w: w["n"].isNotNull()))
    # Windows that select one line start side by side: a group starts where the selected line changes.
    df = df.withColumn(
        "first",
        F.filter(
            F.transform(c("wins"), lambda w, i: F.struct(i.alias("i"), w["p"].alias("p"))),
            lambda g: F.coalesce(F.get(c("wins"), g["i"] - 1)["p"] != g["p"], F.lit(True)),
        ),
    )

    def group(g: Column, k: Column) -> Column:
        after = F.coalesce(F.get(c("first"), k + 1)["i"], F.size(c("wins")))
        last = F.get(c("wins"), after - 1)["n"] + after - 1
        return F.struct(
            F.get(c("lines"), g["p"])["h"].alias("p_hash"),
            g["i"].alias("at"),
            F.slice(c("lines"), g["i"] + 1, last - g["i"]).alias("ctx"),
            (after - g["i"]).alias("n"),
        )

    return df.select("id", "th", F.inline(F.transform(c("first"), group)))


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """(id, th, runs): for every text with a later occurrence of a run, its deleted runs as sorted, disjoint structs
    (from, to) of line numbers, lines without words not counted; th is the 64-bit hash of the text."""
    c = F.col
    found = _windows(docs, id_col, text, min_words)
    shared = found.groupBy("p_hash").agg(F.count("*").alias("times")).where("times > 1").select("p_hash")
    found = found.join(shared, "p_hash", "left_semi")

    def window(i: Column) -> Column:
        """Its hash and length, from the lines that the fingerprint's row carries along."""
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(42).cast("bigint").alias("h"))
        end = F.aggregate(
            F.slice(c("ctx"), i + 1, F.lit(min_words)),
            start,
            lambda a, line: F.when(a["words"] >= min_words, a).otherwise(
                F.struct(
                    (a["words"] + line["w"]).alias("words"),
                    (a["n"] + 1).alias("n"),
                    F.xxhash64(a["h"], line["h"]).alias("h"),
                )
            ),
        )
        return F.struct(i.alias("i"), end.alias("end"))

    wins = found.select(
        "id", "th", "at", F.inline(F.transform(F.sequence(F.lit(0), c("n") - 1), window))
    ).select(
        "id", "th", c("end.h").alias("wh"), (c("at") + c("i")).alias("from"), (c("at") + c("i") + c("end.n") - 1).alias("to")
    )
    wins = checkpointed(wins)
    # A struct with a flag for null ids orders them last.
    place = F.struct(c("id").isNull().alias("none"), "id", "th", c("from").alias("pos"))
    firsts = wins.groupBy("wh").agg(F.min(place).alias("kept"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select("wh", "kept.*").select("wh", c("id").alias("kept_id"), c("th").alias("kept_th"), "pos")
    later = wins.join(firsts, "wh").where(
        ~(c("id").eqNullSafe(c("kept_id")) & (c("th") == c("kept_th")) & (c("from") == c("pos")))
    )
    covered = later.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("all"))
    # Windows sorted by start end in order too, so a run goes on while a window starts no later than one past the end.
    gap = lambda i: F.coalesce(F.get(c("all"), i - 1)["to"] + 1 < F.get(c("all"), i)["from"], F.lit(True))
    starts = F.filter(F.transform(c("all"), lambda w, i: i), gap)
    covered = covered.withColumn("starts", starts)
    runs = F.transform(
        c("starts"),
        lambda i, k: F.struct(
            F.get(c("all"), i)["from"].alias("from"),
            F.get(c("all"), F.coalesce(F.get(c("starts"), k + 1), F.size("all")) - 1)["to"].alias("to"),
        ),
    )
    return covered.select("id", "th", runs.alias("runs"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "removed"
) -> DataFrame:
    """The table with its repeated runs cut out of the texts, and a column of the number of lines deleted."""
    c = F.col
    rid, rth, runs, th, parts, at, spans = fresh(docs, "rid", "rth", "runs", "th", "parts", "at", "spans")
    if removed in docs.columns:
        raise ValueError(f"the table has a column {removed} already")
    found = repeated_runs(docs, id_col, text, min_words).toDF(rid, rth, runs)
    df = docs.withColumn(th, F.xxhash64(text)).join(
        found, c(id_col).eqNullSafe(c(rid)) & (c(th) == c(rth)), "left"
    )
    hit = c(runs).isNotNull()
    df = df.withColumn(parts, F.when(hit, F.split(text, "\n")))
    numbered = F.filter(F.transform(c(parts), lambda x, i: F.struct(_has_word(x).alias("ok"), i.alias("i"))), lambda x: x["ok"])
    df = df.withColumn(at, F.transform(numbered, lambda x: x["i"]))
    df = df.withColumn(
        spans,
        F.transform(
            c(runs),
            lambda r: F.struct(F.get(c(at), r["from"]).alias("from"), F.get(c(at), r["to"]).alias("to"),
                               (r["to"] - r["from"] + 1).alias("n")),
        ),
    )

    def kept(k: Column) -> Column:
        start = F.coalesce(F.get(c(spans), k - 1)["to"] + 1, F.lit(0))
        end = F.coalesce(F.get(c(spans), k)["from"], F.size(parts))
        return F.slice(c(parts), start + 1, F.greatest(end - start, F.lit(0)))

    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), kept))
    lines = F.aggregate(c(spans), F.lit(0), lambda a, s: a + s["n"])
    return df.select(
        *[
            F.when(hit, F.array_join(rest, "\n")).otherwise(c(text)).alias(x) if x == text else c(f"`{x}`")
            for x in docs.columns
        ],
        F.when(hit, lines).otherwise(F.lit(0)).cast("bigint").alias(removed),
    )
