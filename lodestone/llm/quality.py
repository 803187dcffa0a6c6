"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Each rule looks at the counts of one document and votes 1 (good), -1 (bad) or 0 (abstains).
A document's true quality is a hidden class; rules are independent given the class. EM over the
counts of vote patterns (at most 3 to the number of rules, whatever the corpus) estimates the
class share and, for each rule, how often each class gets each vote; a document is kept if its
posterior probability of being good is THRESHOLD or more. All documents count in EM.

A rule may not turn against its meaning: where EM would have it that a bad vote is likelier for
good documents, the two rates are set equal, so that the rule says nothing.

Null and empty text: no words, which fails the base rule (under MIN_WORDS words), so such
documents go. Repeated rows are judged alike. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT, put_back, set_aside, spool, table, word_of

MIN_WORDS, THRESHOLD, ROUNDS = 50, 0.5, 60
#: Very common short words of English, French, German and Spanish.
COMMON_WORDS = frozenset(
    "the be to of and that have with a in is it for as on was are this by at or from "
    "le la les de des du et en un une est que qui pour dans par sur au avec "
    "der die das und ist nicht ein eine zu den mit von auf für im dem sich "
    "el los las y o es por con para una del se no al su lo como más".split()
)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_odd_words long, n_common_words long, n_ended_lines long"
_odd = re.compile(r"[^\w\s]{2,}(?!\S)|(?<!\S)[^\w\s](?!\S)")
_spaces = " \t\n\x0b\x0c\r"


def repeat_words(found: list[str]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(found)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, n)
    size = len(known)
    pair = ids[:-1] * size + ids[1:]
    if size >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        triple = pair[:-1] * size + ids[2:]
    else:
        triple = pair[:-1] * size + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for k in range(3):
        again[twice + k] = True
    return int(again.sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    found = word_of.findall(text)
    seen: set[str] = set()
    lines = dup = ended = 0
    for line in text.split("\n"):
        bare = line.strip(_spaces)
        if bare:
            lines += 1
            dup += line in seen
            ended += bare[-1] in ".!?:;\"'»”"
            seen.add(line)
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    lower = sum(map(len, re.findall(r"[a-zß-öø-ÿ]+", text)))
    return (
        len(found), len(text) - sum(map(text.count, _spaces)), sum(map(text.count, "#*$%&|<>")), dup, repeat_words(found),
        lines, upper, lower, len(_odd.findall(text)), sum(w.lower() in COMMON_WORDS for w in found), ended,
    )


def add_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and the counts of STATS; kept columns named like a count get _in appended."""
    docs, own = set_aside(docs, (*DOCUMENT, text))
    keep = tuple(k for k in docs.columns if own.get(k, k) in keep)
    names = [x.split()[0] for x in STATS.split(", ")]
    read = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([stats_of(x.as_py()) for x in b.column(len(keep))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, np.ascontiguousarray(rows.T))], names=[*keep, *names])

    kept = T.StructType(read.schema.fields[:-1])
    for x in STATS.split(", "):
        kept = kept.add(x.split()[0], T.LongType())
    return put_back(read.mapInArrow(run, kept), {k: c for k, c in own.items() if k in keep})


def rules() -> dict[str, Column]:
    """Votes by name."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    letters = F.greatest(c("n_upper") + c("n_lower"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = c("word_chars") / n
    return {
        "word_length": vote(mean.between(3.0, 10.0), (mean < 2.0) | (mean > 15.0)),
        "symbols": vote(c("n_symbols") <= 0.02 * n, c("n_symbols") > 0.1 * n),
        "dup_lines": vote(c("n_dup_lines") <= 0.1 * lines, c("n_dup_lines") > 0.3 * lines),
        "repeats": vote(c("n_repeat_words") <= 0.15 * n, c("n_repeat_words") > 0.35 * n),
        "upper_case": vote(c("n_upper") <= 0.15 * letters, c("n_upper") > 0.4 * letters),
        "odd_words": vote(c("n_odd_words") <= 0.03 * n, c("n_odd_words") > 0.15 * n),
        "common_words": vote(c("n_common_words") >= 0.1 * n, c("n_common_words") < 0.02 * n),
        "line_ends": vote(c("n_ended_lines") >= 0.5 * lines, (c("n_ended_lines") < 0.1 * lines) & (lines > 3)),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good documents, and rates[rule, class (0 bad, 1 good), vote + 1]."""
    votes = np.array(list(patterns), np.int64).reshape(len(patterns), -1) + 1
    count = np.array(list(patterns.values()), float)
    n_rules = votes.shape[1]
    share, rates = 0.8, np.empty((n_rules, 2, 3))
    for r in range(n_rules):
        silent = (count[votes[:, r] == 1].sum() + 1) / (count.sum() + 3)
        rates[r, 0] = (1 - silent) * 0.6, silent, (1 - silent) * 0.4
        rates[r, 1] = (1 - silent) * 0.1, silent, (1 - silent) * 0.9
    for _ in range(rounds):
        p = posterior(votes, share, rates)
        weight = np.stack([(1 - p) * count, p * count])
        share = float(np.clip((weight[1].sum() + 8) / (count.sum() + 10), 0.05, 0.99))
        for r in range(n_rules):
            for y in (0, 1):
                got = np.bincount(votes[:, r], weights=weight[y], minlength=3) + (np.array([3.0, 1, 2]) if y == 0 else np.array([0.5, 1, 4.5]))
                rates[r, y] = got / got.sum()
            for v, low, high in ((0, 1, 0), (2, 0, 1)):
                if rates[r, low, v] > rates[r, high, v]:
                    rates[r, :, v] = (weight[0].sum() * rates[r, 0, v] + weight[1].sum() * rates[r, 1, v]) / weight.sum()
    return share, rates


def posterior(votes: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    odds = np.full(len(votes), np.log(share) - np.log1p(-share))
    for r in range(votes.shape[1]):
        odds += np.log(rates[r, 1, votes[:, r]]) - np.log(rates[r, 0, votes[:, r]])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge(stats: DataFrame) -> DataFrame:
    """stats with base_failed, p_good and kept; stats is read twice, so it should be stored."""
    named = rules()
    voted = stats.withColumns({f"_{k}": v for k, v in named.items()})
    rows = voted.groupBy(*[f"_{k}" for k in named]).count().collect()
    patterns = {tuple(int(x) for x in r[:-1]): r["count"] for r in rows}
    odds = F.lit(0.0)
    if patterns:
        share, rates = fit(patterns)
        odds = F.lit(float(np.log(share) - np.log1p(-share)))
        for r, k in enumerate(named):
            gain = [float(np.log(rates[r, 1, v]) - np.log(rates[r, 0, v])) for v in range(3)]
            odds = odds + F.when(F.col(f"_{k}") == -1, gain[0]).when(F.col(f"_{k}") == 0, gain[1]).otherwise(gain[2])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD)).drop(*[f"_{k}" for k in named])


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs; each row is judged by its own text, so no join is needed.

    Columns of docs that are named like the counts or the verdicts come through as they are.
    """
    names = [x.split()[0] for x in STATS.split(", ")]
    docs, own = set_aside(docs)
    scored = spool(add_stats(docs, keep=tuple(docs.columns)), "stats")
    return put_back(judge(scored).filter("kept").drop(*names, "p_good", "base_failed", "kept"), own)


def op5_weak_supervision(spark, sf_dir: str) -> DataFrame:
    stats = spool(add_stats(table(spark, sf_dir, "documents")), "stats")
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES = {"op5_weak_supervision": op5_weak_supervision}
ORACLES: dict[str, str] = {}
