"""Mixing to target weights by soft membership: document rates whose expected domain totals meet targets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import stored

#: Letters that are counted one by one: the alphabet and the accented letters of western Europe. All other characters make two more
#: features: by how many bytes those beyond ASCII are longer than they are characters, and how many others there are.
LETTERS = "eansirtoulhdcmgpbvfwkzyjqxéàèêëáâäçíñóöùúüß"
N_FEATURES = len(LETTERS) + 2
#: Shares of the log likelihood that may count (neighbouring letters depend on each other); the one that fits held-out labels best does.
TEMPERS = (0.02, 0.05, 0.1, 0.25, 0.5, 1.0)
#: Parts of the rows: each is scored by a classifier that has not seen its labels.
FOLDS = 2
#: Name of the domains that the targets do not name.
REST = "(other)"


@dataclass
class Mix:
    """A fitted mix: the classifiers' weights by fold, feature and domain, and the gradient steps that give the rates."""

    domains: list[str]
    prior: np.ndarray
    logp: np.ndarray
    temper: float = 1.0
    pull: float = 1e-4
    step: float = 0.0
    gradients: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None
    targets: np.ndarray | None = None
    converged: bool = True

    @property
    def shares(self) -> list[str]:
        return [f"_p{k}" for k in range(len(self.domains))]


def _text(text_col: str) -> Column:
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def n_tokens(text: Column) -> Column:
    """Tokens of a text: its runs of characters that are no white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("double")


def domain_features(docs: DataFrame, id_col: str | Column = "doc_id", domain_col: str = "lang", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, domain, _n (tokens), _fold and _c0, _c1, ... (counts of LETTERS and of all other characters) of every row, written to the shared folder.

    It is the only pass over the texts; null texts count as empty. The columns of `keep` are held in a struct column, row.
    """
    text = F.col("_text")
    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(domain_col).alias("domain"), _text(text_col).alias("_text"), *([F.struct(*keep).alias("row")] if keep else []))
    rest = [x for x in rows.columns if x != "_text"] + ["_n", "_fold", "_size"]
    rows = rows.withColumns({"_n": n_tokens(text), "_fold": F.pmod(F.xxhash64(F.md5("_text")), F.lit(FOLDS)).cast("int"), "_size": F.length("_text")})
    # letter after letter is taken out of what the ones before have left, the frequent ones first: most passes are over short texts
    for i, ch in enumerate(LETTERS):
        rows = rows.selectExpr(*rest, *(f"_z{k}" for k in range(i)), f"octet_length(_text) AS _z{i}", f"replace(_text, '{ch}', '') AS _text")
    last = len(LETTERS)
    rows = rows.selectExpr(*rest, *(f"_z{k}" for k in range(last)), f"octet_length(_text) AS _z{last}")
    counts = [f"(_z{i} - _z{i + 1}) / {len(ch.encode())}D" for i, ch in enumerate(LETTERS)]
    accented = " + ".join(c for c, ch in zip(counts, LETTERS, strict=True) if not ch.isascii())
    counts += [f"_z0 - _size - ({accented})", f"_size - ({' + '.join(counts)})"]
    return stored(rows.selectExpr(*(x for x in rest if x != "_size"), *(f"CAST({c} AS DOUBLE) AS _c{i}" for i, c in enumerate(counts))), "features")


def _named(targets: dict[str, float]) -> Column:
    """A row's domain where the targets name it, REST for any other, null for none."""
    return F.when(F.col("domain").isin(*targets), F.col("domain")).when(F.col("domain").isNotNull(), F.lit(REST))


def fit_domains(features: DataFrame, targets: dict[str, float]) -> Mix:
    """Multinomial classifiers from the rows whose domain is known, one for each fold by the labels of the others: one grouped sum over all rows.

    The share of their log likelihood that counts is the one of TEMPERS under which the held-out labels are likeliest.
    """
    known = features.withColumn("domain", _named(targets)).filter("domain IS NOT NULL")
    found = known.groupBy("domain", "_fold").agg(F.count("*").alias("n"), *(F.sum(f"_c{i}").alias(f"_c{i}") for i in range(N_FEATURES))).collect()
    domains = sorted({r["domain"] for r in found})
    if not domains:
        return Mix([], np.zeros((FOLDS, 0)), np.zeros((FOLDS, N_FEATURES, 0)))
    counts, n = np.ones((FOLDS, N_FEATURES, len(domains))), np.full((FOLDS, len(domains)), 0.5)
    for r in found:
        others = [f for f in range(FOLDS) if f != r["_fold"]]
        counts[others, :, domains.index(r["domain"])] += [r[f"_c{i}"] for i in range(N_FEATURES)]
        n[others, domains.index(r["domain"])] += r["n"]
    mix = Mix(domains, np.log(n / n.sum(1, keepdims=True)), np.log(counts / counts.sum(1, keepdims=True)))
    if len(domains) > 1:
        rows, fits = _log_likelihoods(known, mix), []
        own = F.array_position(F.array(*(F.lit(x) for x in domains)), F.col("domain")).cast("int")
        for temper in TEMPERS:
            logs = F.array(*(F.col(f"_b{k}") + F.col(f"_l{k}") * temper for k in range(len(domains))))
            top = F.array_max(logs)
            whole = F.aggregate(F.transform(logs, lambda x, top=top: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
            fits.append(F.avg(F.element_at(logs, own) - top - F.log(whole)).alias(f"fit{temper}".replace(".", "_")))
        mix.temper = TEMPERS[int(np.argmax(list(rows.agg(*fits).first())))]
    return mix


def _log_likelihoods(features: DataFrame, mix: Mix) -> DataFrame:
    """The rows' other columns, the log prior (_b0, ...) and log likelihood (_l0, ...) of each domain by the fold's classifier."""

    columns = []
    for k in range(len(mix.domains)):
        for name, values in (("b", [f"{float(mix.prior[f, k])!r}D" for f in range(FOLDS)]), ("l", [" + ".join(f"_c{i} * {float(mix.logp[f, i, k])!r}D" for i in range(N_FEATURES)) for f in range(FOLDS)])):
            columns.append("CASE _fold " + " ".join(f"WHEN {f} THEN {v}" for f, v in enumerate(values)) + f" END AS _{name}{k}")
    return features.selectExpr(*(x for x in features.columns if not x.startswith("_c")), *columns)


def posteriors(features: DataFrame, mix: Mix) -> DataFrame:
    """The rows' other columns and _p0, _p1, ...: the probability of each domain by the whole text."""
    d, rest = len(mix.domains), [x for x in features.columns if not x.startswith("_c")]
    rows = _log_likelihoods(features, mix).select(*rest, *((F.col(f"_b{k}") + F.col(f"_l{k}") * mix.temper).alias(f"_l{k}") for k in range(d)))
    top = F.greatest(*(F.col(f"_l{k}") for k in range(d))) if d > 1 else F.col("_l0")
    rows = rows.withColumn("_top", top).select(*rest, *(F.exp(F.col(f"_l{k}") - F.col("_top")).alias(f"_e{k}") for k in range(d)))
    whole = sum((F.col(f"_e{k}") for k in range(1, d)), F.col("_e0"))
    return rows.withColumn("_whole", whole).select(*rest, *((F.col(f"_e{k}") / F.col("_whole")).alias(f"_p{k}") for k in range(d)))


def rate(mix: Mix) -> Column:
    """A row's rate after all gradient steps, from its posteriors: each step is projected to rates of 0 and more."""
    r: Column = F.lit(1.0)
    held = mix.step * mix.pull
    for g in mix.gradients:
        slope: Column = F.lit(float(held))
        for k, x in enumerate(g):
            slope = slope - F.col(f"_p{k}") * float(mix.step * x)
        r = F.greatest(F.lit(0.0), r * (1 - held) + slope)
    return r


def mix_rates(features: DataFrame, targets: dict[str, float], budget: float | None = None, rounds: int = 40, tolerance: float = 2e-4, pull: float = 1e-4) -> tuple[DataFrame, Mix]:
    """id, n_tokens, posterior, rate, copies and converged (and row) of every row of domain_features, and the fitted mix.

    converged tells whether the totals came within `tolerance` of the targets in `rounds` steps; where not, the rates are those of the last step.

    Rows with a domain train the classifiers, each of which scores rows that it has not seen; domains that the targets do not name
    are one. Every row, labelled or not, gets the posterior of its own text. Rates r minimise the squared misses of the domains' expected tokens, sum of r n p, each over its target, plus a pull towards 1,
    by projected gradient steps in the metric of tokens: a step moves a row against its posteriors' mix
    of relative misses, which are one aggregate of as many numbers as domains over all rows; the rates themselves
    are never shuffled or collected. targets gives weights (any scale; domains it does not name get 0);
    budget the tokens of the mix, else the most that the scarcest named domain allows without rates over 1 on average.
    copies is the rate rounded up or down by a hash of the id, so it is the same in every run and its mean is the rate.
    Null ids share a hash, null texts have no tokens and the prior's posterior, repeated rows equal copies; without
    any labelled row or token every rate is 1.
    """
    mix = fit_domains(features, targets)
    mix.pull = pull
    d, own = len(mix.domains), [x for x in features.columns if x == "row"]
    if not d:
        return features.select("id", *own, F.col("_n").cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(mix.converged).alias("converged")), mix
    weights = np.array([float(targets.get(x, 0.0)) for x in mix.domains])
    if not weights.sum() > 0 or (weights < 0).any():
        raise ValueError(f"targets name no domain of {mix.domains}")
    weights /= weights.sum()
    held = stored(posteriors(features.drop("row"), mix), "posteriors")
    p = [F.col(x) for x in mix.shares]
    cross = held.agg(F.sum("_n").alias("n"), *(F.sum(F.col("_n") * x).alias(f"s{k}") for k, x in enumerate(p)), *(F.sum(F.col("_n") * p[a] * p[b]).alias(f"x{a}_{b}") for a in range(d) for b in range(a, d))).first()
    n = cross["n"] or 0.0
    if n:
        sums = np.array([cross[f"s{k}"] for k in range(d)])
        total = budget if budget is not None else float(min(sums[k] / weights[k] for k in range(d) if weights[k] > 0))
        goal = weights * total
        scale = np.maximum(goal, total / (100 * d))
        curve = np.array([[cross[f"x{min(a, b)}_{max(a, b)}"] for b in range(d)] for a in range(d)]) / np.sqrt(np.outer(scale, scale))
        mix.step, mix.targets = 1.0 / (float(np.linalg.eigvalsh(curve).max()) + pull), goal
        # rates start at 1, where the totals are `sums`
        for _ in range(rounds):
            if (np.abs(sums - goal) <= tolerance * scale).all():
                break
            mix.gradients.append((sums - goal) / scale)
            sums = np.array([float(v) for v in held.agg(*(F.sum(rate(mix) * F.col("_n") * x) for x in p)).first()])
        mix.totals, mix.converged = sums, bool((np.abs(sums - goal) <= tolerance * scale).all())
    share = F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = (posteriors(features, mix) if own else held).withColumn("rate", rate(mix))
    return rows.select("id", *own, F.col("_n").cast("long").alias("n_tokens"), F.array(*p).alias("posterior"), "rate", F.floor(F.col("rate") + share).alias("copies"), F.lit(mix.converged).alias("converged")), mix
