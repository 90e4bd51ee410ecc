"""Op 7, mixing to target weights: raking (iterative proportional fitting), then sampling.

Token weights are added up by (source, language, topic). Values that the targets don't name are one value, OTHER,
so there are at most (sources + 1) * (languages + 1) * (topics + 1) cells, by the caller's own lists, and only cells
come to the driver. Raking scales the cells to each marginal in turn until all marginals fit; a target's weight
for values that have no tokens is left out and the rest scaled up. Where the cells can't meet all
targets together (a source with one language only, say), the weights are those after ROUNDS, which meet the last list;
`residual`, the largest distance of a marginal from its target, and a warning say so. A document's probability is its cell's raked
weight over its tokens, scaled so that the largest is `top`; a document stays if a hash of its doc_id and text,
as a number in [0, 1), is below it. So equal inputs give equal samples, wherever and in whatever order they run.

A topic has as its score the number of the text's terms whose hash's residue it is; the topic of the highest score is
the document's, the first by name of those that tie. Terms are all words of TERM's length, or all words at all in a text
without such, in small letters, as often as they occur. That is a stand-in that needs no model; `topic` takes any other
column expression.

Defined results. Null or empty text: no tokens, probability of its cell, or `top` if its cell has no tokens. Null
source or language: OTHER. Repeated rows share their fate, as do all rows of one doc_id and text; null doc_ids too.
A very long text is read once, in the JVM; its weight counts in full. Empty table: empty result. Other columns are
kept, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let, words_of
from .shared import quoted, stored, whole_row

OTHER = "(other)"
SEED = 7
ROUNDS = 5000
TOLERANCE = 1e-10
#: Targets of the query and the pipeline: the large source at a tenth, other sources even; languages and topics even.
SOURCES = {"src0": 0.1} | {f"src{i}": 0.9 / 19 for i in range(1, 20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPICS = {str(i): 0.25 for i in range(4)}


TERM = r"[\p{L}\p{M}\p{N}]{8,}"
ANY_TERM = r"[\p{L}\p{M}\p{N}]+"


def tokens_of(text: Column) -> Column:
    """Words by white space, for the weights."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def topic_of(text: Column, n: int = 4) -> Column:
    """The topic most of the whole text's terms speak for."""

    def terms(t: Column) -> Column:
        every = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(every(TERM), lambda w: F.when(F.size(w) > 0, w).otherwise(every(ANY_TERM)))

    def winner(votes: Column) -> Column:
        names = sorted(map(str, range(n)))
        scores = F.array(*[F.size(F.array_remove(votes, int(k))) for k in names])  # the votes for others
        return let(scores, lambda x: F.get(F.array(*map(F.lit, names)), (F.array_position(x, F.array_min(x)) - 1).cast("int")))

    votes = F.transform(terms(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(n)).cast("int"))
    return let(votes, winner)


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> dict[tuple[str, ...], float]:
    """Weights of the cells, in sum 1, whose marginals are the targets as far as the cells allow."""
    return raked(cells, targets)[0]


def raked(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> tuple[dict[tuple[str, ...], float], float]:
    """The weights, and how far the marginal that fits worst is from its target."""
    keys = sorted(k for k, w in cells.items() if w > 0)
    if not keys:
        return {}, 0.0
    x = np.array([cells[k] for k in keys], float)
    x /= x.sum()
    dims = []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        goal = np.array([max(0.0, target.get(n, 0.0)) for n in names])
        if OTHER in names and OTHER not in target:  # what no target names keeps its share
            share = sum(w for k, w in zip(keys, x, strict=True) if k[d] == OTHER)
            total = goal.sum()
            goal = goal * ((1 - share) / total) if total else goal
            goal[names.index(OTHER)] = share if total else 1.0
        if goal.sum() <= 0:
            raise ValueError("a target names no value that has tokens")
        dims.append((np.array([names.index(k[d]) for k in keys]), goal / goal.sum()))
    apart = 0.0
    for _ in range(ROUNDS):
        for at, goal in dims:
            now = np.bincount(at, x, len(goal))
            x *= np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[at]
        if x.sum() <= 0:
            raise ValueError("the targets leave no cell")
        apart = float(max(np.abs(np.bincount(at, x, len(goal)) - goal).max() for at, goal in dims))
        if apart < TOLERANCE:
            break
    return dict(zip(keys, (x / x.sum()).tolist(), strict=True)), apart


def probabilities(cells: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], top: float = 1.0) -> dict[tuple[str, ...], float]:
    ratio = {k: w / cells[k] for k, w in weights.items()}
    most = max(ratio.values(), default=1.0)
    return {k: top * ratio.get(k, most) / most for k in cells}


def calibrated(docs: DataFrame, sources: dict[str, float] = SOURCES, languages: dict[str, float] = LANGUAGES, topics: dict[str, float] = TOPICS, top: float = 1.0, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """(row, n_tokens, topic, probability, sampled, residual); row has the columns `keep` of docs, or all; residual is that of the raking."""

    def named(c: Column, target: dict[str, float]) -> Column:
        return let(c, lambda x: F.when(x.isin(list(target)), x).otherwise(OTHER))  # c is computed once

    text = quoted(text_col)
    df = docs.select(
        whole_row(docs.select(*map(quoted, keep)) if keep else docs).alias("row"),
        named(quoted(source_col), sources).alias("_s"),
        named(quoted(lang_col), languages).alias("_l"),
        named(topic_of(text) if topic is None else topic, topics).alias("topic"),
        tokens_of(text).alias("n_tokens"),
        F.xxhash64(quoted(id_col).cast("long"), F.coalesce(text, F.lit("")), F.lit(SEED)).alias("_h"),
    )
    df = stored(df, "mixing-facts")  # so that each text is read once
    cells = {tuple(r[:3]): float(r[3]) for r in df.groupBy("_s", "_l", "topic").agg(F.sum("n_tokens")).collect()}
    weights, apart = raked(cells, [sources, languages, topics])
    if apart >= TOLERANCE:
        warnings.warn(f"after {ROUNDS} rounds a marginal is {apart:.3g} from its target: the cells can't meet all targets together", stacklevel=2)
    found = probabilities(cells, weights, top)
    names = [(f"{s}\x00{a}\x00{t}", p) for (s, a, t), p in found.items()]
    table = docs.sparkSession.createDataFrame(names, "_cell string, probability double")  # as many rows as cells
    df = df.withColumn("_cell", F.concat_ws("\x00", "_s", "_l", "topic")).join(F.broadcast(table), "_cell", "left")
    draw = F.shiftrightunsigned("_h", 11).cast("double") / F.lit(float(2**53))
    return df.select("row", "n_tokens", "topic", "probability", (draw < F.col("probability")).alias("sampled"), F.lit(apart).alias("residual"))


def sample(docs: DataFrame, **kw) -> DataFrame:
    return calibrated(docs, **kw).where("sampled").select("row.*")
