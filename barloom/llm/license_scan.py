"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words: A-Z lower-cased, words of letters, digits and all characters past ASCII.
Three base phrases are always found.  Some three hundred hand-written signatures (``license_rules``) run
only on the texts that hold their keywords.  Detections are settled in order, by priority, the longer
and then the earlier first: one goes if it overlaps one of smaller priority number that stays, or lies
within one of equal priority that stays.  Base detections always stay.

Null and empty texts have no words: counts 0, labels empty, first and last null, score 0.  Texts may
have any length; the settling takes time with the square of a text's detections.  Rows are independent:
repeated rows, ties, null ids and further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.license_rules import gates, signatures

#: Base phrases and labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Everything that is not a word character, of text in either case.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_RULES = [(priority, label, *gates(rx), rx) for priority, label, rx in signatures()]


def normal_words(text: Column) -> Column:
    """The text's words, lower-cased, each with a space on either side."""
    return F.lower(F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _GAP, " "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Structs (start, end) in words of every place of ``pattern`` in ``words``, left to right.

    A split gives the pieces between places, an extraction by the same pattern the places.  Word i
    follows i + 1 spaces, so a place begins one word before the spaces up to it.
    """
    pieces = F.split(words, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")))
    hits = F.regexp_extract_all(words, F.concat(F.lit("(?<= )("), pattern, F.lit(")(?= )")), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + _spaces(x["piece"])
        place = F.struct((at - 1).cast("bigint").alias("start"), (at + _spaces(x["hit"])).cast("bigint").alias("end"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct((at + _spaces(x["hit"])).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))
        )

    return F.aggregate(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), zero, step, lambda acc: acc["out"])


def _literal(rows: list[tuple[int, str, list[str], list[str], str]]) -> Column:
    """The rows as one literal array of structs; the optimizer folds the parsing."""
    text = json.dumps([dict(zip(("priority", "label", "keys", "either", "rx"), r, strict=True)) for r in rows])
    return F.from_json(F.lit(text), "array<struct<priority:int,label:string,keys:array<string>,either:array<string>,rx:string>>")


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _within(a: Column, b: Column) -> Column:
    return (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, base, found).

    ``base``: structs (label, priority, start, end) of all places of the base phrases; ``found``:
    those and the detections that suppression leaves.  Starts and ends count words, ends exclusive.
    """
    keys = sorted({k for _, _, own, either, _ in _RULES for k in own + either} | {k for phrase in BASE for k in phrase.split()})
    k, present = F.col("_k"), F.col("_present")
    rows = docs.select("doc_id", normal_words(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", "_w", F.split("_w", " ").alias("_a"))
    # Keywords come from the words themselves by hashing, not from a search for each.
    known = F.array_intersect(F.col("_a"), F.array(*[F.lit(x) for x in keys]))
    rows = rows.select("doc_id", "_w", (F.size("_a") - 2).alias("_n"), known.alias("_present"))
    n_words = F.when(F.col("_w") == " ", F.lit(0)).otherwise(F.col("_n")).cast("bigint")
    rows = rows.select("doc_id", n_words.alias("n_words"), "_present", F.when(F.size("_present") > 0, F.col("_w")).alias("_k"))

    rule = _literal(_RULES)
    first = _literal([(0, label, phrase.split(), [], phrase) for phrase, label in BASE.items()])
    none = F.array().cast("array<struct<label:string,priority:int,start:bigint,end:bigint>>")

    def detections(chosen: Column) -> Column:
        own = lambda r: F.transform(_places(k, r["rx"]), lambda x: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), x["start"].alias("start"), x["end"].alias("end")))
        return F.flatten(F.transform(chosen, own))

    def matching(among: Column) -> Column:
        gate = lambda r: F.forall(r["keys"], lambda x: F.array_contains(present, x)) & ((F.size(r["either"]) == 0) | F.arrays_overlap(r["either"], present))
        return F.filter(among, lambda r: gate(r) & F.rlike(k, F.concat(F.lit("(?<= )(?:"), r["rx"], F.lit(")(?= )"))))

    rows = rows.withColumn("base", F.when(k.isNotNull(), F.sort_array(detections(matching(first)))).otherwise(none))
    rows = rows.withColumn("_all", F.when(k.isNotNull(), detections(matching(rule))).otherwise(none))
    beats = lambda a, b: (_overlaps(a, b) & (b["priority"] < a["priority"])) | (_within(a, b) & (b["priority"] == a["priority"]))
    turn = F.array_sort(F.transform(F.col("_all"), lambda x: F.struct(x["priority"].alias("priority"), (x["start"] - x["end"]).alias("size"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"))))
    kept = F.aggregate(turn, none, lambda stay, x: F.when(F.exists(stay, lambda b: beats(x, b)), stay).otherwise(F.concat(stay, F.array(F.struct(x["label"].alias("label"), x["priority"].alias("priority"), x["start"].alias("start"), x["end"].alias("end"))))))
    return rows.select("doc_id", "n_words", "base", F.sort_array(F.array_distinct(F.concat(F.col("base"), kept))).alias("found"))
