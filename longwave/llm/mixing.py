"""Mixing to target weights by soft membership, in DataFrame operations only.

1. A naive Bayes classifier over the hashed words that a document has or lacks is counted from a labelled table; it
   gives every document a posterior over domains.  Only buckets that one domain's documents hold significantly
   more often than the others' count, so that rare words, which are most, add no noise.
2. Each document i has n_i tokens, a posterior p_i and a rate r_i >= 0, one at the start.  The expected
   tokens of domain k are T_k = sum_i r_i n_i p_ik.  Projected gradient steps lower the squared distance of
   T from the targets, whitened by M, the sum of n_i p_i p_i' over documents whose rate is above zero:
   r_i <- max(0, r_i - p_i . M^-1 (T - target)).  While no rate meets the bound, one step is exact.  A step
   needs one aggregation of a few numbers per pair of domains; rates are never gathered.
3. A document of rate r appears floor(r) times, once more with probability r - floor(r), drawn from its id.

The total of the targets is ``budget`` times what makes the domain of the largest weight fit without
repeating or dropping, so that most of its documents keep a rate near one.

Defined results: null and empty texts and texts of blanks have no tokens, the prior as posterior, and a rate
like any other.  A domain without labelled rows gets no posterior and its target weight goes to the others.
Targets that no rates reach are approached as far as the steps go; ``residual`` tells by how much the worst is missed.
Without any labelled row, or any token, all rates are one.  Rows of equal id and text get equal results.
Texts are read whole.  Columns named like the results are replaced, others carried along.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwave.llm.durable import at_random, durable

BUCKETS = 16384
#: The classifier counts at most so many labelled documents, those of the smallest hashed ids.
FIT_ROWS = 20000
#: Pseudo-documents of a domain; a bucket counts if so large a share of a domain's documents holds it, by so many
#: standard deviations more than expected.
PSEUDO, SHARE, CLEAR = 2.0, 0.02, 5.0
STEPS, CLOSE = 25, 1e-6


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, tuple[float, list[float]]]:
    """Per domain the log odds of a text without any telling word, and what each bucket adds, from labels (doc_id, domain)."""
    known = labels.where("domain is not null and doc_id is not null").select("doc_id", "domain")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(fit_rows)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    read = texts.select("domain", F.array_distinct(F.transform(_words(F.col("text")), _bucket)).alias("buckets"))
    # A row without words still counts as a document, under no bucket.
    counted = read.select("domain", F.explode_outer("buckets").alias("bucket")).groupBy("domain", "bucket").count().collect()
    size = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total, held, by_domain = sum(size.values()), [0] * BUCKETS, {d: {} for d in sorted(size)}
    for r in counted:
        if r["bucket"] is not None:
            by_domain[r["domain"]][r["bucket"]] = r["count"]
            held[r["bucket"]] += r["count"]
    telling: set[int] = set()
    for domain, counts in by_domain.items():
        share = size[domain] / total
        telling |= {b for b, n in counts.items() if n >= SHARE * size[domain] and n - held[b] * share >= CLEAR * math.sqrt(held[b] * share + 1)}
    model = {}
    for domain, counts in by_domain.items():
        base, gains = math.log(size[domain] / total), [0.0] * BUCKETS
        for b in telling:
            p = (counts.get(b, 0) + PSEUDO * held[b] / total) / (size[domain] + PSEUDO)
            base += math.log1p(-min(p, 1 - 1e-9))
            gains[b] = math.log(p) - math.log1p(-min(p, 1 - 1e-9))
        model[domain] = (base, gains)
    return model


def posteriors(docs: DataFrame, model: Mapping[str, tuple[float, list[float]]]) -> DataFrame:
    """docs with n_tokens and one column ``p_<domain>`` per domain of the model."""
    domains = list(model)
    kept = [c for c in docs.columns if c != "n_tokens" and c not in {f"p_{d}" for d in domains}]
    words = F.transform(_words(F.col("text")), _bucket)
    read = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), words.alias("all")).select("kept", F.size("all").cast("long").alias("n"), F.array_distinct("all").alias("buckets"))
    base = model[domains[0]][1]
    scores = [F.lit(model[domains[0]][0])]
    for d in domains[1:]:
        # A literal of fixed size, as one text that is read once: as one literal per number, planning takes seconds.
        gain = ", ".join(repr(x - y) if x != y else "0.0" for x, y in zip(model[d][1], base, strict=True))
        scores.append(F.lit(model[d][0]) + F.expr(f"aggregate(buckets, 0D, (t, b) -> t + from_json('[{gain}]', 'array<double>')[b])"))
    read = read.select("kept", "n", *(s.alias(f"s{k}") for k, s in enumerate(scores)))
    top = F.greatest(*(F.col(f"s{k}") for k in range(len(domains)))) if len(domains) > 1 else F.col("s0")
    raised = [F.exp(F.col(f"s{k}") - top) for k in range(len(domains))]
    total = sum(raised[1:], raised[0])
    return read.select(*(F.col(f"kept.`{c}`").alias(c) for c in kept), F.col("n").alias("n_tokens"), *((x / total).alias(f"p_{d}") for d, x in zip(domains, raised, strict=True)))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric system by elimination; a little is added to the diagonal for absent domains."""
    n = len(right)
    lift = 1e-12 * max(1e-300, max(matrix[k][k] for k in range(n)))
    a = [[*row, right[k]] for k, row in enumerate(matrix)]
    for k in range(n):
        a[k][k] += lift
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        for i in range(k + 1, n):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k], strict=True)]
    out = [0.0] * n
    for k in reversed(range(n)):
        out[k] = (a[k][n] - sum(a[k][j] * out[j] for j in range(k + 1, n))) / a[k][k]
    return out


def fit_rates(members: DataFrame, domains: list[str], weights: Mapping[str, float], budget: float = 1.0) -> tuple[Column, float]:
    """The rate of a row of members (n_tokens, p_<domain>), as an expression over these columns, and the residual.

    Domains without a weight are left free.
    """
    domains = [d for d in domains if d in weights]
    if not domains:
        return F.lit(1.0), 0.0
    p = [F.col(f"`p_{d}`") for d in domains]
    n = F.col("n_tokens").cast("double")
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def state(rate: Column):
        rated = members.withColumn("__rate", rate)
        free = F.when(F.col("__rate") > 0, n).otherwise(0.0)
        return rated.agg(
            *(F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs), *(F.sum(F.col("__rate") * n * x).alias(f"t{i}") for i, x in enumerate(p))
        ).first()

    rate = F.lit(1.0)
    now = state(rate)
    have = [now[f"t{i}"] or 0.0 for i in range(k)]
    wanted = [max(0.0, weights.get(d, 0.0)) for d in domains]
    if sum(have) <= 0 or sum(wanted) <= 0:
        return rate, 0.0
    main = max(range(k), key=lambda i: wanted[i])
    total = budget * have[main] / wanted[main]
    target = [total * w for w in wanted]
    missed = lambda: max(abs(x - y) for x, y in zip(have, target, strict=True)) / max(sum(target), 1.0)
    for _ in range(STEPS):
        off = [x - y for x, y in zip(have, target, strict=True)]
        if missed() <= CLOSE:
            break
        move = _solve([[now[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], off)
        rate = F.greatest(F.lit(0.0), rate - sum((p[i] * F.lit(move[i]) for i in range(1, k)), p[0] * F.lit(move[0])))
        now = state(rate)
        have = [now[f"t{i}"] for i in range(k)]
    return rate, missed()


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], budget: float = 1.0, fit_rows: int = FIT_ROWS, keep_text: bool = False) -> DataFrame:
    """docs without text, with n_tokens, p_<domain>, rate, copies and residual (the worst miss of a target, as a share of all).

    With ``keep_text`` the text stays: posteriors are then taken again as rows are read, so that no text is shuffled or kept twice.
    """
    model = learn(docs, labels, fit_rows)
    made = ("text", "rate", "copies", "residual", "n_tokens", *(f"p_{d}" for d in model))
    kept = [c for c in docs.columns if c not in made]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    read = docs.select(row, F.xxhash64("doc_id", F.xxhash64("text")).alias("draw"), "text")
    shown = [F.col(f"row.`{c}`").alias(c) for c in kept] + [F.col("text")] * keep_text
    if not model:
        none = read.select(*shown, F.size(_words(F.col("text"))).cast("long").alias("n_tokens"))
        return none.select("*", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(0.0).alias("residual"))
    members = durable(posteriors(read.select("text") if keep_text else read, model).drop("text"))
    rate, residual = fit_rates(members, list(model), weights, budget)
    rated = (posteriors(read, model) if keep_text else members).withColumn("rate", rate)
    copies = F.floor(F.col("rate") + at_random("draw")).cast("long").alias("copies")
    return rated.select(*shown, "n_tokens", *(F.col(f"`p_{d}`") for d in model), "rate", copies, F.lit(residual).alias("residual"))
