"""Quality rules: text statistics, a fixed base test, and a learned decision list of threshold conjunctions.

Sequential covering grows one conjunction at a time on labelled statistics,
prunes it on rows that did not grow it, keeps it only if it is precise there,
and goes on with the rows it leaves. The list becomes an ordered Spark
conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlake.llm.text import mix, prefix_hash, runs_of, span_hash, text_buffers, window_hash, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words"]
#: Labelled rows that the list is learned from, at most; chosen by a hash of the id.
SAMPLE = 12_000
WINDOW = 8


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_MARK = _table("!?")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    _, first = np.unique(mix(keys + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(doc[first], minlength=n)


def chunk_stats(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS + EXTRA of each text of a chunk."""
    n = len(offsets) - 1
    s, e, first = words_of(data, offsets)
    n_words = np.diff(first)
    doc_w = np.repeat(np.arange(n), n_words)
    c = prefix_hash(data)
    wh = span_hash(c, s, e)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
    points = inside[e] - inside[s]
    word_chars = np.bincount(doc_w, points, minlength=n).astype(np.int64)

    ls, le, lfirst = runs_of(data != 0x0A, offsets)
    has_word = np.searchsorted(s, le) > np.searchsorted(s, ls)  # a word starts within the line
    ls, le = ls[has_word], le[has_word]
    doc_l = np.searchsorted(offsets, ls, "right") - 1
    n_lines = np.bincount(doc_l, minlength=n)
    n_dup = n_lines - _distinct(span_hash(c, ls, le), doc_l, n)

    covered = np.zeros(len(s) + 1, np.int64)
    win = window_hash(wh, WINDOW)
    if len(win):
        whole = np.flatnonzero(doc_w[: len(win)] == doc_w[WINDOW - 1 :])
        keys = mix(win[whole] + mix(doc_w[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = whole[twice]
        covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + WINDOW, minlength=len(covered) + WINDOW)[: len(covered)]
    n_repeat = np.bincount(doc_w, np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64) if len(s) else np.zeros(n, np.int64)
    flags = [_sums(t[data], offsets) for t in (_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK)]
    return [n_words, word_chars, flags[0], n_dup, n_repeat, n_lines, *flags[1:], _distinct(wh, doc_w, n)]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text; null text has none of anything. Map-only."""
    names = COUNTS + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_buffers(batch.column(1)):
                cols = [pa.array(x.astype(np.int64)) for x in chunk_stats(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in names))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))


def features() -> dict[str, Column]:
    """What the learned conditions may compare: lengths and shares, never labels or metadata."""
    w = F.col("n_words")
    return {
        "n_words": w.cast("double"),
        "mean_word": _ratio(F.col("word_chars"), w),
        "symbol_share": _ratio(F.col("n_symbols"), w),
        "dup_line_share": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_share": _ratio(F.col("n_repeat_words"), w),
        "upper_share": _ratio(F.col("n_upper"), F.col("n_letters")),
        "digit_share": _ratio(F.col("n_digits"), F.col("word_chars")),
        "mark_share": _ratio(F.col("n_marks"), w),
        "distinct_share": _ratio(F.col("n_distinct_words"), w),
        "words_a_line": _ratio(w, F.col("n_lines")),
    }


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, cut in rule:
        out &= x[name] > cut if op == ">" else x[name] <= cut
    return out


def learn_list(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 8, most_rules: int = 12
) -> list[Rule]:
    """Ordered conjunctions that mark rows to reject; empty where nothing precise can be said."""
    rules: list[Rule] = []
    n = len(bad)
    if n < 4 * least or bad.all() or not bad.any():
        return rules
    grow = np.arange(n) % 3 != 2
    alive = np.ones(n, bool)
    names = list(x)
    while len(rules) < most_rules:
        g = alive & grow
        if (g & bad).sum() < least:
            break
        rule: Rule = []
        inside = g.copy()
        while len(rule) < 3 and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if p0 == 0:
                break
            best, found = 0.0, None
            for name in names:
                v = x[name][inside]
                b = bad[inside]
                order = np.argsort(v, kind="stable")
                vs, cum = v[order], np.cumsum(b[order])
                steps = np.flatnonzero(vs[1:] > vs[:-1])
                if not len(steps):
                    continue
                low_p = cum[steps].astype(float)
                low_n = steps + 1 - low_p
                for op, p, q in (("<=", low_p, low_n), (">", p0 - low_p, n0 - low_n)):
                    ok = p >= least
                    gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(p + q, 1)) - np.log2(p0 / (p0 + n0))), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best + 1e-9:
                        best, found = float(gain[k]), (name, op, float((vs[steps[k]] + vs[steps[k] + 1]) / 2))
            if found is None:
                break
            rule.append(found)
            inside &= _covers([found], x)
        held = alive & ~grow

        def worth(r: Rule, held=held) -> float:
            c = _covers(r, x) & held
            return ((c & bad).sum() - (c & ~bad).sum()) / max(c.sum(), 1) if r else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x) if rule else np.zeros(n, bool)
        pg, ph = c & alive & grow, c & held
        if not rule or (pg & bad).sum() < precision * pg.sum() or (ph & bad).sum() < precision * ph.sum() or not pg.any():
            break
        rules.append(rule)
        alive &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: False from the first rule that holds, else True."""
    f = features()
    out = None
    for rule in rules:
        cond = F.lit(True)
        for name, op, cut in rule:
            cond = cond & (f[name] > F.lit(cut) if op == ">" else f[name] <= F.lit(cut))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Documents of at most ``most`` labelled rows outside the held-out fold, as doc_id, text, y.

    The fold: crc32 of the id as text, modulo 4, is 2. Rows are chosen by a hash of the id.
    """
    ids = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
        .groupBy(id_col)
        .agg(F.min("quality").alias("y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(most)
    )
    return docs.select(F.col(id_col), "text").join(F.broadcast(ids), id_col)


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    sample = labelled_sample(docs, labels, most)
    y = sample.select(F.col("doc_id").alias("_id"), "y").dropDuplicates(["_id"])
    f = features()
    rows = (
        text_stats(sample.groupBy("doc_id").agg(F.min("text").alias("text")))  # one of rows that share an id
        .join(F.broadcast(y), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "y", *[c.alias(n) for n, c in f.items()])
        .toPandas()
        .sort_values("doc_id")
    )
    return learn_list({n: rows[n].to_numpy(float) for n in f}, rows["y"].to_numpy() == 0) if len(rows) else []


def apply_rules(docs: DataFrame, rules: list[Rule], **columns) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    base_failed: fewer than 20 words, or over 30 words in 100 inside repeated
    8-word windows. kept is false there, else the list's verdict.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return text_stats(docs, **columns).select(
        "doc_id", *COUNTS, base.alias("base_failed"), F.when(base, False).otherwise(verdict(rules)).alias("kept")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    return apply_rules(docs, fit_rules(docs, labels, most))
