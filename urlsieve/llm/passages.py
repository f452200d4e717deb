"""Removing passages of over 50 words that stand elsewhere, wherever in a line they begin or end, in DataFrame functions only.

Seeds are winnowed: of each 26 neighbouring words the least by hash, the first among equals, starts a run of 26 words. Two
equal runs of 51 words hold the same seed, so only around seeds that occur more than once are runs of 51 words compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import WORD, free, quoted, scope, written

#: Words in the shortest passage that goes, and in a seed.
WORDS, SEED_WORDS = 51, 26
#: Bits of a word's position: a text has fewer words than that.
PLACE = 31


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _run(name: str, at: Column, size: int) -> list[Column]:
    """The elements at, at + 1, ... of an array; a slice of each place would copy the whole array."""
    return [F.col(name)[at + k] for k in range(size)]


def seeds(keyed: DataFrame) -> DataFrame:
    """(id, th, pos, seed): the seeds of texts of 51 words or more, by the position of their first word.

    Positions stand in the low bits of the words' hashes, so that the least of neighbouring ones is the first among
    equals; the least of 26 comes from those of 2, 4, 8 and 16.
    """
    rows = keyed.select("id", "th", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= WORDS)
    marked = F.zip_with("w", F.sequence(F.lit(0), F.size("w") - 1), lambda h, i: F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(i.cast("long")))
    rows = rows.select("id", "th", "w", marked.alias("m"))
    for far in (1, 2, 4, 8, SEED_WORDS - 16):
        rows = rows.select("id", "th", "w", F.zip_with("m", F.slice("m", 1 + far, F.size("m")), lambda x, y: F.least(x, y)).alias("m"))
    least = F.transform(F.slice("m", F.lit(1), F.size("w") - WORDS + 1), lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    rows = rows.select("id", "th", "w", F.array_distinct(least).alias("at"))
    return rows.select("id", "th", F.inline(F.transform("at", lambda p: F.struct(p.alias("pos"), F.xxhash64(*_run("w", p, SEED_WORDS)).alias("seed")))))


def runs(held: DataFrame) -> DataFrame:
    """(h1, h2, id, th, pos): the runs of 51 words that hold one of a text's seeds (at), by 128 bits of hash.

    Hashes of 2, 4, ... 32 words come from those of half as many; a run's is that of 32, 16, 2 and one of its words.
    """
    w = word_hashes(F.col("text"))
    around = F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(p - (WORDS - SEED_WORDS), F.lit(0)), F.least(p, F.size("a1") - WORDS))))
    rows = held.select("id", "th", "at", w.alias("a1")).select("id", "th", "a1", F.transform("a1", lambda x: F.xxhash64(F.lit(1), x)).alias("b1"), F.array_distinct(around).alias("spots"))
    for k in (1, 2, 4, 8, 16):
        rows = rows.withColumns({f"{c}{2 * k}": F.zip_with(f"{c}{k}", F.slice(f"{c}{k}", k + 1, F.size(f"{c}{k}")), lambda x, y: F.xxhash64(x, y)) for c in "ab"})

    def run(p: Column) -> Column:
        parts = [F.xxhash64(F.col(f"{c}32")[p], F.col(f"{c}16")[p + 32], F.col(f"{c}2")[p + 48], F.col(f"{c}1")[p + 50]) for c in "ab"]
        return F.struct(parts[0].alias("h1"), parts[1].alias("h2"), p.alias("pos"))

    return rows.select("id", "th", F.inline(F.transform("spots", run))).select("h1", "h2", "id", "th", "pos")


def islands(spans: DataFrame) -> DataFrame:
    """(_id, _th, gone): the unions of a document's spans [a, z) that share or touch a place, in order.

    A window and two aggregates within a document: one shuffle, and no array is copied for each span.
    """
    order = Window.partitionBy("_id", "_th").orderBy("a", "z")
    far = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("a") > far, F.lit(True)).cast("int")
    rows = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("_id", "_th", "_island").agg(F.struct(F.min("a").alias("a"), F.max("z").alias("z")).alias("span"))
    return rows.groupBy("_id", "_th").agg(F.sort_array(F.collect_list("span")).alias("gone"))


def without(cuts: DataFrame) -> DataFrame:
    """(id, th, cut): texts without the words at the spans of `gone` ([a, z), apart and in order), and without the space after each run of them.

    What stays are the stretches of words between spans, each with the spaces between its words and the one after its last.
    """
    # a text is gap, word, gap, ..., word, gap
    rows = cuts.select("id", "th", "gone", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.split("text", WORD, -1).alias("gaps"))
    rows = rows.select("id", "th", "gone", "w", "gaps", F.zip_with("w", F.slice("gaps", 1, F.size("w")), lambda w, g: F.concat(g, w)).alias("both"))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: F.least(g["z"], F.size("w"))))
    ends = F.concat(F.transform("gone", lambda g: F.least(g["a"], F.size("w"))), F.array(F.size("w")))
    stays = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"] < x["e"])

    def stretch(x: Column) -> Column:
        rest = F.array_join(F.slice("both", x["s"] + 2, F.greatest(x["e"] - x["s"] - 1, F.lit(0))), "")
        return F.concat(F.get("w", x["s"]), rest, F.when(x["e"] < F.size("w"), F.get("gaps", x["e"])).otherwise(F.lit("")))

    body = F.array_join(F.transform(stays, stretch), "")
    kept = F.coalesce(F.element_at("gone", -1)["z"] < F.size("w"), F.lit(True))
    last = F.when(kept, F.element_at("gaps", -1)).otherwise(F.lit(""))
    return rows.select("id", "th", F.when(F.size("w") > 0, F.concat(F.get("gaps", F.lit(0)), body, last)).otherwise(F.lit("")).alias("cut"))


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with each run of 51 words or more that stands in an earlier place cut from the text; a row per row.

    Words are compared, not the spaces between them. Places are ordered by id (null first), text hash and position; a
    later one that overlaps the first in the same document loses only what lies beyond it. Rows equal in id and text
    count as one document and keep the same text. Null and empty texts stay. An empty table gives no rows. Other columns
    may have any names.
    """
    text = F.col(quoted(text_col))
    keyed = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    with scope(docs.sparkSession) as keep:
        # a document is (id, th); its text is kept only where one of its seeds stands in another place, too
        place = F.struct("id", "th", "pos")
        found = written(seeds(keyed.where("text IS NOT NULL")), "seeds", "zstd")
        spot = F.xxhash64("id", "th", "pos")
        again = found.groupBy("seed").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low != high").select("seed")
        own = found.join(again, "seed").groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("at"))
        held = keyed.join(own, keyed["id"].eqNullSafe(F.col("_id")) & (keyed["th"] == F.col("_th"))).select("id", "th", "text", "at")
        held = written(held.dropDuplicates(["id", "th"]), "held")

        places = written(runs(held), "runs", "zstd")
        first = places.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f")
        later = places.join(first, ["h1", "h2"]).where(place > F.col("f"))
        same = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th"))
        start = F.when(same, F.greatest("pos", F.col("f.pos") + WORDS)).otherwise(F.col("pos"))
        spans = later.select(F.col("id").alias("_id"), F.col("th").alias("_th"), start.alias("a"), (F.col("pos") + WORDS).alias("z"))
        gone = islands(spans)
        cuts = held.join(gone, held["id"].eqNullSafe(F.col("_id")) & (held["th"] == F.col("_th"))).select("id", "th", "text", "gone")
        cuts = keep(written(without(cuts), "cuts"))
    one, th, cut = free(docs, "_id", "_th", "_cut")
    cuts = cuts.select(F.col("id").alias(one), F.col("th").alias(th), F.col("cut").alias(cut))
    both = docs.join(cuts, docs[quoted(id_col)].cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(docs[quoted(text_col)]) == F.col(th)), "left")
    return both.select(*[F.coalesce(F.col(cut), text).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
