"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of ``P`` transformed statistics. Per language and source the
centre and scatter of the vectors are estimated by (regularised) minimum covariance
determinant: the half of the rows, ``(n + P + 1) / 2`` of them, whose floored
scatter has the smallest determinant. From several starts (medians with median
absolute deviations, spatial signs, a tanh correlation, two random subsets)
concentration steps (C-steps) take the rows with the smallest Mahalanobis distance
and estimate again from them; after two steps the two starts of smallest determinant
go on until no determinant falls further, and the smallest wins. The
consistency-corrected estimate is reweighted: all rows within its 97.5 % ellipsoid
make the final one. A row is rejected when its distance to that is beyond the cutoff,
or its base rule failed.

Half of the rows is the subset of highest breakdown: outliers are found up to a
share of nearly one half of a group's usable rows. A group with more of them than
that is described by them, and they are kept.

The method needs more than ``LEAST = 5 P`` rows (the usual advice for it). So the
estimate of a language and source is a weighted mean of its own and its language's, its
own weighing ``(n - LEAST) / n`` where ``n > LEAST`` and nothing below; the language's
is drawn to that of all rows alike. There is no other switch: a source of 30 rows
leans on its language, one of a million on itself. Where all rows are ``LEAST`` or fewer,
nothing is rejected by distance.

Everything is computed over all rows. A C-step is one aggregation with map-side
combining over the vectors (some 60 bytes a document, written once to the shared folder):
rows fall into logarithmic bins of their distance, whose counts, sums and products
give the subset of any size, the last bin in part. The estimates, some 30 numbers a
group and start, are joined back: by broadcast up to ``MAX_GROUPS`` groups, beyond
that by a shuffle with salted keys, so that no group lies in one task.

Rows whose base rule failed take no part in an estimate. Null or empty text: no
words, so the base rule fails. Null lang or source is a value of its own. An
empty table gives an empty result; repeated rows are judged each, and count each.
Extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import batch, binary, materialize, only, slices

SYMBOLS = b"#*$%&|<>"
#: Groups whose estimates are broadcast at most (some 20 MB); salts of the join beyond.
MAX_GROUPS, SALTS = 20_000, 64
#: Mahalanobis distance squared beyond which a row is rejected: the chi-squared quantile with 5 degrees of freedom at 1 - 1e-9.
CUTOFF = 52.0
#: Standard deviations added to the scatter, by statistic, so that one that hardly varies (symbols in clean prose) doesn't reject trifles.
FLOOR = (0.25, 0.12, 0.02, 0.1, 0.1)
P = len(FLOOR)
#: Rows beyond which a group's own estimate counts.
LEAST = 5 * P
#: What the scatter of the half is widened by: 0.5 / the chi-squared cdf with 7 degrees of freedom at the median of that with 5.
HALF_SCALE = 1.913
#: Reweighting: the chi-squared quantile at 97.5 %, and what the scatter of the rows within it is widened by (0.975 / the cdf with 7 degrees of freedom there).
CHI2_NEAR, NEAR_SCALE = 12.833, 1.0555
#: Starts that go on after ``TRIAL`` C-steps; C-steps at most; a fall of the logarithm of a determinant that counts; bins for each doubling of the distance.
BEST, TRIAL, STEPS, FALL, BINS = 2, 2, 20, 1e-2, 8

_STATS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())] + [(f"x{i}", pa.float64()) for i in range(P)]
_STATS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"x{i} double" for i in range(P))


def repeated_words(w: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    grams = list(zip(w, w[1:], w[2:]))
    seen, twice = set(), set()
    if len(set(grams)) == len(grams):
        return 0
    for g in grams:
        (twice if g in seen else seen).add(g)
    n = upto = 0
    for i, g in enumerate(grams):
        if g in twice:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def text_stats(t: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    w = t.split()
    joined = b"".join(w)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in t.split(b"\n") if x.strip()]
    return len(w), chars, len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(w), len(lines)


def _measure(schema: pa.Schema, n_keep: int, text_at: int):
    def run(batches):
        for rb in batches:
            text = binary(rb.column(text_at))
            for a, b in slices(text):
                s = np.array([text_stats(t or b"") for t in text.slice(a, b - a).to_pylist()], np.int64).T
                n, chars, symbols, dup, rep, lines = s
                failed = (n < 50) | (100 * rep > 50 * n)
                x = [np.log1p(n), (chars + 5.0 * 50) / (n + 50), symbols / np.maximum(n, 1), dup / np.maximum(lines, 1), rep / np.maximum(n, 1)]
                yield batch(schema, [*(rb.column(i).slice(a, b - a) for i in range(n_keep)), n, chars, symbols, dup, rep, failed, *x])

    return run


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (text among them or not) with the statistics of each text, and its group keys."""
    src = only(docs, *keep, *([] if "text" in keep else ["text"]))
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in src.schema.fields[: len(keep)]]
    ddl = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in keep)
    df = src.mapInArrow(_measure(pa.schema(fields + _STATS), len(keep), src.columns.index("text")), f"{ddl}, {_STATS_DDL}")
    lang = [F.lit("l"), F.col("lang").isNull(), F.col("lang")]
    return df.withColumn("gl", F.xxhash64(*lang)).withColumn("gs", F.xxhash64(*lang, F.lit("s"), F.col("source").isNull(), F.col("source")))


def _attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` with a table of groups: broadcast if it is small, else with salted keys, so no group gathers in a task."""
    if table.count() <= MAX_GROUPS:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ONE = "start int, logdet double, fall double, centre array<double>, scatter array<double>, inverse array<double>"
_PARAMS = f"g long, starts array<struct<{_ONE.replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"
_STARTS = pa.schema([("g", pa.int64()), ("starts", pa.list_(pa.struct([("start", pa.int32()), ("logdet", pa.float64()), ("fall", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("centre", "scatter", "inverse"))])))])
_GROUND = np.diag(np.square(FLOOR))


def _sums(cols: list[str], weight: F.Column | None = None) -> list[F.Column]:
    """n, s: count, sums and products of the vectors, as one array."""
    w = F.lit(1.0) if weight is None else weight
    return [F.array(F.sum(w), *[F.sum(F.col(c) * w) for c in cols], *[F.sum(F.col(cols[i]) * F.col(cols[j]) * w) for i, j in _PAIRS]).alias("s")]


def _moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of summed vectors."""
    c = s[1 : P + 1] / s[0]
    m = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        m[i, j] = m[j, i] = s[P + 1 + k] / s[0] - c[i] * c[j]
    return c, m


def _estimate(start: int, centre: np.ndarray, scatter: np.ndarray, last: float = np.inf, scale: float = 1.0) -> dict:
    """One start's parameters; ``scatter`` without the floor."""
    floored = scatter * scale + _GROUND
    logdet = float(np.linalg.slogdet(floored)[1])
    return {"start": start, "logdet": logdet, "fall": float(min(last - logdet, 1e9)), "centre": centre.tolist(), "scatter": scatter.ravel().tolist(), "inverse": np.linalg.inv(floored).ravel().tolist()}


def subset(bins: list[tuple[int, np.ndarray]], n: float) -> np.ndarray:
    """The sums of the ``h = (n + P + 1) // 2`` nearest of ``n`` rows: bins by rising distance, the last one in part."""
    left, total = min(n, (n + P + 1) // 2), np.zeros(1 + P + len(_PAIRS))
    for _, s in sorted(bins, key=lambda b: b[0]):
        part = min(1.0, left / s[0])
        total += s * part
        left -= s[0] * part
        if left <= 0:
            break
    return total


def _each(fn):
    """Group by group, ``fn(row)`` to the group's list of estimates."""

    def run(batches):
        for rb in batches:
            rows = [(r["g"], fn(r)) for r in rb.to_pylist()]
            yield batch(_STARTS, [[g for g, _ in rows], [e for _, e in rows]])

    return run


def _begin(r: dict) -> list[dict]:
    """The starts of a group, from its medians, deviations and the sums of its transformed rows."""
    centre, sd = np.array(r["mid"]), np.sqrt(np.square(np.array(r["mad"]) * 1.4826) + np.square(FLOOR))
    out = [_estimate(0, centre, np.diag(np.square(sd) - np.square(FLOOR)))]
    for x in r["sums"]:
        s = np.array(x["s"])
        if x["start"] <= 2:  # a correlation about the medians, from signs or tanh values
            m = np.zeros((P, P))
            for k, (i, j) in enumerate(_PAIRS):
                m[i, j] = m[j, i] = s[P + 1 + k]
            d = np.sqrt(np.maximum(np.diag(m), 1e-12))
            out.append(_estimate(x["start"], centre, (m / np.outer(d, d) * 0.95 + np.eye(P) * 0.05) * np.outer(sd, sd)))
        else:
            out.append(_estimate(x["start"], *_moments(s)))
    return out


def _concentrate(keep: int | None):
    def step(r: dict) -> list[dict]:
        by: dict[int, list] = {}
        for x in r["bins"]:
            by.setdefault(x["start"], []).append((x["bin"], np.array(x["s"])))
        last = {x["start"]: x["logdet"] for x in r["before"]}
        out = [_estimate(k, *_moments(subset(b, r["n"])), last[k]) for k, b in by.items()]
        out.sort(key=lambda e: (e["logdet"], e["start"]))
        return out[:keep]

    return step


def _widen(r: dict) -> list[dict]:
    """The estimate of smallest determinant, made consistent."""
    best = min(r["starts"], key=lambda e: (e["logdet"], e["start"]))
    return [_estimate(best["start"], np.array(best["centre"]), np.reshape(best["scatter"], (P, P)), scale=HALF_SCALE)]


def _reweighted(r: dict) -> list[dict]:
    c, m = _moments(np.array(r["s"]))
    return [_estimate(0, c, m * NEAR_SCALE)]


def _distance(centre, inverse) -> F.Column:
    d = [F.col(f"x{i}") - centre[i] for i in range(P)]
    terms = [d[i] * d[j] * inverse[i * P + j] * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _near(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Each row with each start of its groups: start, d2."""
    both = _attach(rows, params, "g").withColumn("p", F.explode("starts"))
    return both.withColumn("d2", _distance(F.col("p.centre"), F.col("p.inverse"))).withColumn("start", F.col("p.start"))


def _measured(r: DataFrame, fn, ddl: str = _PARAMS) -> DataFrame:
    return materialize(r.mapInArrow(_each(fn), ddl))


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gs, gl, n) and (g, starts): languages and sources with their usable rows, and the final estimates, one in ``starts``, of all of more than LEAST rows, of each language and of all (0)."""
    groups = materialize(stats.groupBy("gs", "gl").agg(F.count_if(~F.col("base_failed")).alias("n")))
    own = groups.filter(F.col("n") > LEAST).select(F.col("gs").alias("g"))
    # vectors with each group that they take part in: a source with enough rows, the language, all
    rows = stats.filter(~F.col("base_failed")).select("gs", "gl", *_X)
    rows = materialize(rows.withColumn("g", F.explode(F.array("gs", "gl", F.lit(0).cast("long")))).select("g", "gs", "gl", *_X).join(_hint(own.withColumn("own", F.lit(True))), "g", "left").filter("own or g <> gs").select("g", *_X))
    mid = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(x, 0.5) for x in _X]).alias("mid")))
    off = _attach(rows, mid.select("g", F.col("mid").alias("m")), "g").groupBy("g").agg(F.array(*[F.percentile_approx(F.abs(F.col(x) - F.col("m")[i]), 0.5) for i, x in enumerate(_X)]).alias("mad"))
    mid = materialize(mid.join(off, "g"))
    # the starts: standardised rows as signs (1) or by tanh (2), and random subsets of about 2 (P + 1) rows (3, 4)
    z = _attach(rows, mid, "g")
    z = z.withColumns({f"z{i}": (F.col(x) - F.col("mid")[i]) / F.sqrt(F.pow(F.col("mad")[i] * 1.4826, 2) + FLOOR[i] ** 2) for i, x in enumerate(_X)})
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-18)))
    drawn = lambda k: F.pmod(F.xxhash64(F.lit(k), *_X), F.lit(1 << 30)) * F.col("n") < F.lit(2 * (P + 1) * (1 << 30))
    vector = lambda cols: F.array(*cols)
    kinds = F.array(F.struct(F.lit(1).alias("start"), vector([F.col(f"z{i}") / norm for i in range(P)]).alias("v")), F.struct(F.lit(2).alias("start"), vector([F.tanh(f"z{i}") for i in range(P)]).alias("v")), *[F.when(drawn(k), F.struct(F.lit(k).alias("start"), vector([F.col(x) for x in _X]).alias("v"))) for k in (3, 4)])
    z = z.select("g", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("g", "k.start", *[F.col("k.v")[i].alias(f"v{i}") for i in range(P)])
    sums = z.groupBy("g", "start").agg(*_sums([f"v{i}" for i in range(P)])).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "s"))).alias("sums"))
    params = _measured(mid.join(sums, "g"), _begin)
    for step in range(1, STEPS + 1):
        binned = _near(rows, params).withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * BINS).cast("int"))
        binned = binned.groupBy("g", "start", "bin").agg(*_sums(_X)).groupBy("g").agg(F.collect_list(F.struct("start", "bin", "s")).alias("bins"))  # some hundred bins for each start at most
        params = _measured(binned.join(mid.select("g", "n"), "g").join(params.withColumnRenamed("starts", "before"), "g"), _concentrate(BEST if step >= TRIAL else None))
        if step > TRIAL and not params.filter(F.exists("starts", lambda e: e["fall"] > FALL)).limit(1).count():
            break
    near = _near(rows, _measured(params, _widen)).filter(F.col("d2") <= CHI2_NEAR)
    return groups, _measured(near.groupBy("g").agg(*_sums(_X)), _reweighted)


def _hint(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_GROUPS else table


_FINAL = pa.schema([("gs", pa.int64()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])


def blend(estimates: list[tuple[int, list | None]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Centre and scatter of the innermost group. ``estimates``: from all rows inwards, rows and (centre, scatter) if there are."""
    centre = scatter = None
    for n, e in estimates:
        if e is None or n <= LEAST:
            continue
        c, m = np.array(e[0]), np.reshape(e[1], (P, P))
        w = 1.0 if centre is None else (n - LEAST) / n
        centre, scatter = (c, m) if centre is None else (w * c + (1 - w) * centre, w * m + (1 - w) * scatter)
    return None if centre is None else (centre, scatter)


def _blended(batches):
    for rb in batches:
        out = []
        for r in rb.to_pylist():
            e = blend([(r[f"n{k}"] or 0, r[f"e{k}"] and [r[f"e{k}"]["centre"], r[f"e{k}"]["scatter"]]) for k in ("a", "l", "s")])
            out.append((r["gs"], *((None, None) if e is None else (e[0].tolist(), np.linalg.inv(e[1] + _GROUND).ravel().tolist()))))
        yield batch(_FINAL, list(zip(*out)) if out else [[], [], []])


def judge(stats: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    """``stats`` with distance2 (null where there are LEAST usable rows or fewer) and kept."""
    e = params.select("g", F.col("starts")[0].alias("e"))
    of = lambda key, name: e.select(F.col("g").alias(key), F.col("e").alias(name))
    by_lang, total = groups.groupBy("gl").agg(F.sum("n").alias("nl")), groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("na")).first()[0]
    table = groups.withColumnRenamed("n", "ns").join(by_lang, "gl").withColumn("na", F.lit(total)).withColumn("ga", F.lit(0).cast("long"))
    table = table.join(of("gs", "es"), "gs", "left").join(of("gl", "el"), "gl", "left").join(of("ga", "ea"), "ga", "left")
    table = materialize(table.select("gs", "ns", "nl", "na", "es", "el", "ea").mapInArrow(_blended, "gs long, centre array<double>, inverse array<double>"))
    df = _attach(stats, table, "gs").withColumn("distance2", F.when(F.col("centre").isNotNull(), _distance(F.col("centre"), F.col("inverse"))))
    return df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF))


def rate_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, distance2 and kept."""
    stats = materialize(measure(docs, ["doc_id", "lang", "source"]))
    return judge(stats, *fit(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without those rejected. Texts are measured once and written with their statistics, never shuffled."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    usable = materialize(measure(docs, cols).filter("not base_failed"))
    return judge(usable, *fit(usable)).filter("kept").select(*cols)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
