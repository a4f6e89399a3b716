"""Residue instead of content: unfilled placeholders, form prompts, leaked values, filler, error pages and script notices.

A post's address is its thread, whose question's first line stands for slug and title. Each unit (a line's sentence) of a
text is judged by its syntax and vocabulary (``residue_rules``), after code, quotations and quoted lines are masked. That
is a suspicion only; template syntax apart, other evidence decides: whether the unit's terms are those
of the title and of the rest of the body, whether the host (``source``) gives the same response in several threads, and whether
the post says anything besides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join
from candlewright.llm.residue_rules import LETTERS, MANNER, MARKS_RE, STRONG, TEMPLATE, TEMPLATE_RE, WEAK, Judge, letter_pairs, split_units, without_code
from candlewright.session import materialise

#: A post is residue from this score on.
ENOUGH = 2.0
#: Each piece of evidence beside a unit's own weight; terms shared with title and body count against it, and where
#: there is nothing to compare half the weight stands. A suspicious unit alone in its post is not enough.
MISMATCH = DUPLICATED = 0.5
BARE = 0.25
#: Threads of a source that must hold the same unit, digits and fillings aside, for it to count as duplicated.
THREADS = 3
#: A weakly suspicious unit of fewer terms cannot be told from a short answer that is often given; nor is less a body.
LEAST_UNIT_TERMS = 4
#: A response that nothing in its wording makes suspicious: so many threads of one source hold it, nearly
#: only there, with so many terms and off nearly every thread's subject.
REPEATED, ONE_HOST, LEAST_TERMS, OFF_TOPIC = 20, 0.9, 6, 0.95
PRIOR = 20.0

_DIGITS = re.compile(r"\d+")
_UNIT = "struct<kind:string,weight:double,terms:array<int>,print:int,alone:boolean>"
_POST = f"struct<units:array<{_UNIT}>,title:array<int>,prose:array<int>,print:bigint>"


def pair_model(documents: DataFrame) -> np.ndarray:
    """Log-probabilities of the next letter, given the one before and not: (2, LETTERS, LETTERS), from all texts.

    Every text has the same weight (1,000 pairs, fewer if it is shorter), so that no long dump sets the rule; the
    prior of ``PRIOR`` pairs a cell keeps a small corpus from finding everything unlikely. ``LETTERS`` ** 2 numbers reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LETTERS * LETTERS)
        for pdf in batches:
            total += letter_pairs([without_code(t) for t in pdf["text"] if t], 1000.0)
        yield pd.DataFrame({"pair": np.arange(len(total)), "n": total})

    rows = documents.select("text").mapInPandas(count, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LETTERS * LETTERS)
    for r in rows:
        n[r["pair"]] = r["n"]
    n = n.reshape(LETTERS, LETTERS) + PRIOR
    alone = np.log(n.sum(0) / n.sum())
    return np.stack([np.log(n / n.sum(1, keepdims=True)), np.broadcast_to(alone, n.shape)])


def look(text: str | None, asks: bool, judge: Judge) -> tuple[list[dict], list[int], list[int], int | None]:
    """(suspicious units, title terms, prose terms, fingerprint) of one whole text.

    The title is the first line of a question, as far as it is content; all of it is where a body follows, template syntax apart. Prose is all other content; what a site or a form could
    say without being suspicious is neither. A form is suspicious if two of its labels or more are (headings, or what ends in a colon) are followed by nothing that was filled in. alone: the post says little besides, and more than one weakly
    suspicious unit stands for that. The fingerprint hashes all units, digits and fillings masked.
    """
    units = split_units(text) if text else []
    if not units:
        return [], [], [], None
    judged = [judge.unit(u) for u in units]
    heads = len(split_units(text.strip().split("\n", 1)[0])) if asks else 0
    prose = {t for kind, weight, terms, _ in judged[heads:] if not weight and kind != MANNER for t in terms}
    if len(prose) >= LEAST_UNIT_TERMS:  # what a title with a body below it says is the subject, however a site might say it
        judged[:heads] = [j if j[1] >= TEMPLATE else ("", 0.0, *j[2:]) for j in judged[:heads]]
    title = {t for kind, weight, terms, _ in judged[:heads] if not weight and kind != MANNER for t in terms}
    masked = "\n".join(units).lower()
    if MARKS_RE.search(masked):
        masked = TEMPLATE_RE.sub("□", masked)
    print_ = int.from_bytes(hashlib.blake2b(_DIGITS.sub("#", masked).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    labels = [i for i, u in enumerate(units) if u[-1] == ":" or u[0] == "#" or u[:2] == u[-2:] == "**"]
    unfilled = [i for i in labels if i + 1 < len(units) and (judged[i + 1][0] == MANNER or judged[i + 1][0] == "draft")]
    if len(unfilled) > 1:
        terms = frozenset(t for i in unfilled for t in judged[i + 1][2])
        judged.append(("form", STRONG, terms, zlib.crc32(repr([units[i] for i in unfilled]).encode("utf-8", "replace")) - 2**31))
        for i in labels:
            judged[i] = (MANNER, *judged[i][1:])
    found = []
    if any(weight for _, weight, _, _ in judged):
        said = sum(len(terms) for kind, weight, terms, _ in judged if weight or kind == MANNER)
        other = sum(len(terms) for kind, weight, terms, _ in judged[1:] if not weight and kind != MANNER)
        several = sum(weight > 0 or kind == MANNER for kind, weight, _, _ in judged) > 1
        for kind, weight, terms, unit_print in judged:
            if weight:
                alone = said >= other and (weight > WEAK or kind == "machine" or several)
                found.append({"kind": kind, "weight": weight, "terms": list(terms), "print": unit_print, "alone": alone})
    return found, list(title), list(prose), print_


def _threads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact number of threads per key: (keys, _threads). Rows of a hot key are reduced before they meet."""
    return rows.select(*keys, "_thread").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_threads"))


def _off_topic(terms: Column, title: Column, prose: Column, asks: Column) -> Column:
    """Are at most a third of the terms among those of title and body? NULL if there is nothing to compare; a question without any content is off topic."""
    known = F.array_union(F.coalesce(title, F.array().cast("array<int>")), F.coalesce(prose, F.array().cast("array<int>")))
    nothing = (F.size(known) == 0) | (F.size(terms) == 0)
    return F.when(nothing, F.when(asks, F.lit(True))).otherwise(3 * F.size(F.array_intersect(terms, known)) <= F.size(terms))


def residue_evidence(documents: DataFrame, titles: bool = True, hosts: bool = True) -> DataFrame:
    """Evidence on every suspicious post: (doc_id, kinds, weight, mismatched, duplicated, alone, score, residue).

    A post is residue if one of its units scores ``ENOUGH``: its own weight (template syntax has enough by itself), plus
    ``MISMATCH`` where its terms are not those of the thread's title and the post's other content, minus
    ``MISMATCH`` where they are (half of it where there is nothing to compare), plus ``DUPLICATED`` where the same unit stands in ``THREADS`` threads of the source or more, plus ``BARE``
    where the post says little besides. The row shows the unit of the highest score. A post in whose wording
    nothing is suspicious has the kind ``repeated`` if ``REPEATED`` threads of its source hold the whole
    response, others hardly any, and it is off the subject of nearly all of them.

    A NULL source is a host of its own; a post without question_id is its own thread. NULL and empty texts are no
    residue. Whole texts are read, of any length. Rows with the same doc_id give one row. An empty table
    gives no rows; other columns are ignored. ``titles`` and ``hosts`` switch those kinds of evidence off, for measuring what they do.

    One pass trains letter pairs, one judges units; its slim results (hashes) are written to the shared folder. Only
    suspicious units and fingerprints are counted and joined, hot keys salted.
    """
    pairs = pair_model(documents)

    @F.pandas_udf(_POST)
    def inspect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = Judge(pairs)
        for texts, asks in batches:
            rows = [look(t, bool(a), judge) for t, a in zip(texts, asks)]
            frame = pd.DataFrame(rows, columns=["units", "title", "prose", "print"])
            frame["print"] = frame["print"].astype("Int64")
            yield frame

    thread = F.coalesce("question_id", "doc_id")
    asks = F.coalesce(thread == F.col("doc_id"), F.lit(False))
    posts = documents.select("doc_id", thread.alias("_thread"), asks.alias("_asks"), "source", inspect("text", asks).alias("r"))
    posts = materialise(posts.select("doc_id", "_thread", "_asks", "source", "r.*"))  # several readers follow

    named = posts.filter(F.col("_asks") & (F.size("title") > 0)).groupBy("_thread").agg(F.first("title").alias("_title"))

    def placed(rows: DataFrame) -> DataFrame:
        return salted_join(rows, named, "_thread", "doc_id", salts=4, how="left") if titles else rows.withColumn("_title", F.lit(None).cast("array<int>"))

    # suspicious units
    units = posts.filter(F.size("units") > 0).select("doc_id", "_thread", "_asks", "source", "prose", F.explode("units").alias("u"))
    units = units.select("doc_id", "_thread", "_asks", "source", "prose", "u.kind", "u.weight", "u.terms", F.col("u.print").alias("_print"), "u.alone")
    often = _threads(units, ["source", "_print"]).filter(F.col("_threads") >= THREADS)
    seen = salted_join(placed(units), often, ["source", "_print"], "doc_id", how="left")
    off = _off_topic(F.col("terms"), F.col("_title"), F.col("prose"), F.col("_asks")) if titles else F.lit(None).cast("boolean")
    told = F.col("_threads").isNotNull() & ((F.col("weight") > WEAK) | (F.size("terms") >= LEAST_UNIT_TERMS)) if hosts else F.lit(False)
    seen = seen.select("doc_id", "kind", "weight", off.alias("mismatched"), told.alias("duplicated"), "alone")
    against = F.when(F.col("mismatched"), MISMATCH).when(F.col("mismatched").isNull(), MISMATCH / 2).when(F.col("weight") < TEMPLATE, -MISMATCH).otherwise(0.0)
    against = against if titles else F.lit(0.0)
    score = F.col("weight") + against + F.when(F.col("duplicated"), DUPLICATED).otherwise(0.0) + F.when(F.col("alone"), BARE).otherwise(0.0)
    best = F.max_by(F.struct("weight", "mismatched", "duplicated", "alone", score.alias("score")), F.struct(score, "weight"))
    wording = seen.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), best.alias("b")).select("doc_id", "kinds", "b.*")
    if not (titles and hosts):
        return wording.withColumn("residue", F.col("score") >= ENOUGH)

    # whole responses in whose wording nothing is suspicious
    counts = _threads(posts.filter(F.col("print").isNotNull()).select("source", F.col("print").alias("_print"), "_thread"), ["source", "_print"])
    of_host = F.struct("_threads", "source")
    everywhere = counts.groupBy("_print").agg(F.sum("_threads").alias("_all"), F.max_by(of_host, "_threads").alias("_h"))
    own = everywhere.filter((F.col("_h._threads") >= REPEATED) & (F.col("_h._threads") >= ONE_HOST * F.col("_all"))).select("_print", F.col("_h.source").alias("source"))
    plain = posts.filter((F.size("units") == 0) & (F.size("prose") >= LEAST_TERMS)).select("doc_id", "_thread", "_asks", "source", "prose", F.col("print").alias("_print"))
    plain = placed(salted_join(plain, own, ["source", "_print"], "doc_id"))
    plain = materialise(plain.select("doc_id", "source", "_print", (F.size(F.array_intersect("_title", "prose")) == 0).alias("mismatched")))  # read twice
    strange = plain.groupBy("source", "_print").agg(F.avg(F.coalesce("mismatched", F.lit(False)).cast("double")).alias("_off")).filter(F.col("_off") >= OFF_TOPIC).drop("_off")
    repeated = salted_join(plain, strange, ["source", "_print"], "doc_id").groupBy("doc_id").agg(F.max("mismatched").alias("mismatched"))
    repeated = repeated.select(
        "doc_id", F.array(F.lit("repeated")).alias("kinds"), F.lit(WEAK).alias("weight"), "mismatched", F.lit(True).alias("duplicated"), F.lit(True).alias("alone"),
        (F.lit(WEAK + DUPLICATED) + F.when(F.col("mismatched"), MISMATCH).otherwise(0.0)).alias("score"),
    )
    return wording.unionByName(repeated).withColumn("residue", F.col("score") >= ENOUGH)


def residue_posts(documents: DataFrame) -> DataFrame:
    """doc_id of the posts that hold residue in place of content; leave them out with an anti join."""
    return residue_evidence(documents).filter("residue").select("doc_id")
