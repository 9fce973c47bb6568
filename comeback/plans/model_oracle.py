"""The fitted models' queries as plain SQL for DuckDB: forests of stumps, folds, attribution, clusters."""

from __future__ import annotations

from comeback.operators.stumps import DRAWS, PRIME
from comeback.plans.oracle import (
    _CLUSTER,
    _EARLY,
    _EVENT_NAMES,
    _FULL,
    _KEY,
    _MATRIX,
    _NAMED,
    _PROFILE,
    _RADAR,
    _RATES,
    _Z,
    pct,
    r1,
    r4,
    r6,
    unpivot,
    with_parts,
)
from comeback.plans.oracle import SQL as RELATIONAL
from comeback.plans.testlog import TEST_SETTINGS

SEED, BINS, FOLDS = TEST_SETTINGS.seed, TEST_SETTINGS.tree_bins, TEST_SETTINGS.folds
FULL = (*_FULL, *sorted(f"evt_{name}" for name in _EVENT_NAMES))
TREES = {"full": 200, "early": 200, "upgrade": 100}
COLUMNS = {"full": FULL, "early": _EARLY, "upgrade": _EARLY}
LABELS = {"full": "is_successful", "early": "is_successful", "upgrade": "is_upgrade_candidate"}

FEATS = f"""matrix AS (SELECT person_id, {_MATRIX} FROM ev GROUP BY person_id),
feats AS (SELECT mart.*, {", ".join(f"evt_{n}" for n in _EVENT_NAMES)} FROM mart JOIN matrix USING (person_id))"""


def rows_of(tag: str) -> str:
    """``row<tag>``: person, label, hash key, split, fold; ``cell<tag>``: a row per person and feature."""
    columns, label = COLUMNS[tag], LABELS[tag]
    values = ", ".join(f"{c}::DOUBLE" for c in columns)
    return f"""row_{tag} AS (
  SELECT person_id, label, key, CASE WHEN rn <= greatest(1, floor(size * 0.2)) THEN 'test' ELSE 'train' END AS split,
         ((rn - 1) * {FOLDS} // size)::INT AS fold
  FROM (SELECT person_id, {label} AS label, {_KEY} AS key,
               row_number() OVER (PARTITION BY {label} ORDER BY {_KEY}, person_id) AS rn,
               count(*) OVER (PARTITION BY {label}) AS size FROM mart)),
cell_{tag} AS (SELECT person_id, unnest([{values}]) AS x, unnest(range({len(columns)})) AS f FROM feats)"""


def slots_of(tag: str, where: str) -> str:
    """``slot<tag>``: the value range of every training value, with its least and largest value."""
    return f"""value_{tag} AS (
  SELECT f, x, count(*) AS c FROM cell_{tag} JOIN row_{tag} USING (person_id) WHERE {where} GROUP BY f, x),
cum_{tag} AS (
  SELECT f, x, sum(c) OVER (PARTITION BY f ORDER BY x) AS cum, row_number() OVER (PARTITION BY f ORDER BY x) AS rk,
         count(*) OVER (PARTITION BY f) AS many, sum(c) OVER (PARTITION BY f) AS total FROM value_{tag}),
slot_{tag} AS (
  SELECT f, x, slot, min(x) OVER (PARTITION BY f, slot) AS low, max(x) OVER (PARTITION BY f, slot) AS top
  FROM (SELECT f, x, CASE WHEN many <= {BINS} THEN rk ELSE (cum - 1) * {BINS} // total END AS slot FROM cum_{tag})),
edge_{tag} AS (SELECT DISTINCT f, slot, low, top FROM slot_{tag})"""


def draws_of(tag: str) -> str:
    """``pick<tag>``: features of each tree; ``draw<tag>``: how often each row is in a tree's sample."""
    features = len(COLUMNS[tag])
    tried = max(1, int(features**0.5))
    times = " + ".join(f"(u >= {limit})::INT" for limit in DRAWS)
    return f"""pick_{tag} AS (
  SELECT t, f FROM (
    SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY md5(concat('{SEED}:', t, ':', f)), f) AS r
    FROM range({TREES[tag]}) AS a(t), range({features}) AS b(f)) WHERE r <= {tried}),
hash_{tag} AS (
  SELECT t, ('0x' || substr(md5(concat('{SEED}:', t)), 1, 7))::BIGINT + 1 AS a, ('0x' || substr(md5(concat('{SEED}:', t)), 8, 8))::BIGINT AS b
  FROM range({TREES[tag]}) AS r(t)),
draw_{tag} AS (
  SELECT * FROM (SELECT person_id, label, fold, split, t, {times} AS times
                 FROM (SELECT *, (key * a + b) % {PRIME} AS u FROM row_{tag}, hash_{tag})) WHERE times > 0)"""


def best_of(tag: str, cells: str, by: str = "") -> str:
    """``rule<tag>``: the rule of every (by, tree) with the fewest errors."""
    group = f"{by}t, f"
    return f"""run_{tag} AS (
  SELECT {group}, slot, pos, neg, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg,
         sum(pos) OVER (PARTITION BY {group}) AS apos, sum(neg) OVER (PARTITION BY {group}) AS aneg
  FROM {cells} WINDOW w AS (PARTITION BY {group} ORDER BY slot)),
rule_{tag} AS (
  SELECT {by}t, f, polarity, errors, lpos, lneg, apos, aneg, CASE polarity WHEN 1 THEN low ELSE top END AS threshold
  FROM (SELECT *, row_number() OVER (PARTITION BY {by}t ORDER BY errors, f, slot, polarity DESC) AS r FROM (
      SELECT *, 1 AS polarity, cpos - pos + aneg - cneg + neg AS errors, cpos - pos AS lpos, cneg - neg AS lneg FROM run_{tag} UNION ALL
      SELECT *, -1 AS polarity, apos - cpos + cneg AS errors, cpos AS lpos, cneg AS lneg FROM run_{tag}))
  JOIN edge_{tag} USING (f, slot) WHERE r = 1)"""


def forest(tag: str) -> str:
    """``rule<tag>`` of the training split and ``vote<tag>``, the share of rules for every person."""
    return f"""{rows_of(tag)},
{slots_of(tag, "split = 'train'")},
{draws_of(tag)},
drawn_{tag} AS (
  SELECT t, f, slot, coalesce(sum(times) FILTER (WHERE label = 1), 0) AS pos, coalesce(sum(times) FILTER (WHERE label <> 1), 0) AS neg
  FROM draw_{tag} JOIN pick_{tag} USING (t) JOIN cell_{tag} USING (person_id, f) JOIN slot_{tag} USING (f, x)
  WHERE split = 'train' GROUP BY t, f, slot),
{best_of(tag, f"drawn_{tag}")},
same_{tag} AS (SELECT f, polarity, threshold, count(*) AS n FROM rule_{tag} GROUP BY ALL),
vote_{tag} AS (
  SELECT person_id, sum(CASE WHEN polarity * (x - threshold) >= 0 THEN n ELSE 0 END) / (SELECT count(*) FROM rule_{tag}) AS p
  FROM cell_{tag} JOIN same_{tag} USING (f) GROUP BY person_id),
scored_{tag} AS (SELECT person_id, label, p, split FROM row_{tag} JOIN vote_{tag} USING (person_id) WHERE split = 'test')"""


def folds(tag: str) -> str:
    """``held<tag>``: every person scored by the forest of the other folds."""
    return f"""{rows_of(tag)},
{slots_of(tag, "TRUE")},
{draws_of(tag)},
own_{tag} AS (
  SELECT fold, t, f, slot, coalesce(sum(times) FILTER (WHERE label = 1), 0) AS pos, coalesce(sum(times) FILTER (WHERE label <> 1), 0) AS neg
  FROM draw_{tag} JOIN pick_{tag} USING (t) JOIN cell_{tag} USING (person_id, f) JOIN slot_{tag} USING (f, x)
  GROUP BY fold, t, f, slot),
rest_{tag} AS (
  SELECT a.fold, o.t, o.f, o.slot, sum(o.pos) AS pos, sum(o.neg) AS neg
  FROM (SELECT range AS fold FROM range({FOLDS})) a JOIN own_{tag} o ON o.fold <> a.fold GROUP BY ALL HAVING sum(o.pos) + sum(o.neg) > 0),
{best_of(tag, f"rest_{tag}", "fold, ")},
same_{tag} AS (SELECT fold, f, polarity, threshold, count(*) AS n FROM rule_{tag} GROUP BY ALL),
held_{tag} AS (
  SELECT person_id, any_value(label) AS label, fold,
         sum(CASE WHEN polarity * (x - threshold) >= 0 THEN n ELSE 0 END) / (SELECT count(*) FROM rule_{tag} r WHERE r.fold = d.fold) AS p
  FROM row_{tag} d JOIN cell_{tag} USING (person_id) JOIN same_{tag} USING (fold, f) GROUP BY person_id, fold),
areas AS (
  SELECT fold, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
  FROM (SELECT * FROM held_{tag} WHERE label = 1) a JOIN (SELECT * FROM held_{tag} WHERE label = 0) b USING (fold) GROUP BY fold)"""


def scored(tag: str) -> str:
    return f"SELECT person_id, label, p AS probability, (p > 0.5)::INT AS prediction, split FROM scored_{tag}"


ALL = unpivot([f"SELECT '{tag}' AS model, person_id, label, p FROM scored_{tag}" for tag in TREES])
FORESTS = (FEATS, *map(forest, TREES), f"every AS ({ALL})")
RISK = """risk AS (
  SELECT person_id, p AS success_probability,
         CASE WHEN p < 0.3 THEN '🔴 High Risk' WHEN p < 0.6 THEN '🟡 Medium Risk' ELSE '🟢 Likely Success' END AS risk_flag FROM vote_early)"""
SIDE = "CASE WHEN {0} + {1} > 0 THEN 2.0::DOUBLE * {0} * {1} / ({0} + {1}) ELSE 0 END"
GAIN = (
    f"({SIDE.format('apos', 'aneg')} - ({SIDE.format('lpos', 'lneg')} + {SIDE.format('(apos - lpos)', '(aneg - lneg)')}))"
    " / (apos + aneg)"
)
#: Part of a rule's drawn rows for which it predicts 1.
PART = "(CASE polarity WHEN -1 THEN lpos + lneg ELSE apos + aneg - lpos - lneg END) / (apos + aneg)"
NAMES = "[" + ", ".join(f"'{c}'" for c in FULL) + "]"

SQL: dict[str, str] = {
    "rf_full": with_parts("mart", scored("full"), FEATS, forest("full")),
    "rf_day3": with_parts("mart", scored("early"), FEATS, forest("early")),
    "rf_upgrade": with_parts("mart", scored("upgrade"), FEATS, forest("upgrade")),
    "model_evaluation": with_parts(
        "mart",
        f"""SELECT model, tp, fp, fn, tn, {_RATES}, {r4("auc")} AS auc FROM (
              SELECT model, count(*) FILTER (WHERE p > 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p > 0.5 AND label = 0) AS fp,
                     count(*) FILTER (WHERE p <= 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p <= 0.5 AND label = 0) AS tn
              FROM every GROUP BY model) JOIN (
              SELECT model, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
              FROM (SELECT * FROM every WHERE label = 1) a JOIN (SELECT * FROM every WHERE label = 0) b USING (model) GROUP BY model)
            USING (model)""",
        *FORESTS,
    ),
    "model_roc_curves": with_parts(
        "mart",
        f"""SELECT model, {r6("t")} AS threshold,
                   {r6("count(*) FILTER (WHERE label = 0 AND p >= t) / count(*) FILTER (WHERE label = 0)")} AS fpr,
                   {r6("count(*) FILTER (WHERE label = 1 AND p >= t) / count(*) FILTER (WHERE label = 1)")} AS tpr
            FROM every JOIN (SELECT DISTINCT model, p AS t FROM every UNION ALL SELECT model, max(p) + 1 FROM every GROUP BY model)
            USING (model) GROUP BY model, t""",
        *FORESTS,
    ),
    "day3_threshold_sweep": with_parts(
        "mart",
        f"""SELECT threshold, tp, fp, fn, tn, {_RATES} FROM (
              SELECT round_even((0.1 + i * 0.05) * 100, 0)::DOUBLE / 100 AS threshold,
                     count(*) FILTER (WHERE p >= t AND label = 1) AS tp, count(*) FILTER (WHERE p >= t AND label = 0) AS fp,
                     count(*) FILTER (WHERE p < t AND label = 1) AS fn, count(*) FILTER (WHERE p < t AND label = 0) AS tn
              FROM scored_early, (SELECT i, 0.1::DOUBLE + i * ((0.9::DOUBLE - 0.1::DOUBLE) / 16) AS t FROM range(17) AS steps(i))
              GROUP BY i)""",
        FEATS,
        forest("early"),
    ),
    "risk_scores": with_parts("mart", "SELECT * FROM risk", FEATS, forest("early"), RISK),
    "risk_distribution": with_parts(
        "mart", "SELECT risk_flag, count(*) AS users FROM risk GROUP BY risk_flag", FEATS, forest("early"), RISK
    ),
    "cv_auc": with_parts("mart", f"SELECT fold, {r6('auc')} AS auc FROM areas", FEATS, folds("full")),
    "cv_auc_interval": with_parts(
        "mart",
        f"""SELECT {r4("avg(auc)")} AS mean_auc, {r4("stddev_pop(auc)")} AS std_auc,
                   {r4("avg(auc) - 1.96 * stddev_pop(auc)")} AS ci_lo, {r4("avg(auc) + 1.96 * stddev_pop(auc)")} AS ci_hi
            FROM areas""",
        FEATS,
        folds("full"),
    ),
    "feature_importance": with_parts(
        "mart",
        f"""SELECT feature, {r6("importance")} AS importance FROM (
              SELECT {NAMES}[f + 1] AS feature, coalesce(gain, 0) / (SELECT sum({GAIN}) FROM rule_full) AS importance
              FROM range({len(FULL)}) AS r(f) LEFT JOIN (SELECT f, sum({GAIN}) AS gain FROM rule_full GROUP BY f) USING (f))
            ORDER BY importance DESC, feature LIMIT 15""",
        FEATS,
        forest("full"),
    ),
    "vote_attribution": with_parts(
        "mart",
        f"""SELECT person_id, {NAMES}[f + 1] AS feature, {r6("amount")} AS contribution FROM (
              SELECT person_id, f, sum((polarity * (x - threshold) >= 0)::INT - part) / (SELECT count(*) FROM rule_full) AS amount
              FROM row_full JOIN cell_full USING (person_id) JOIN (SELECT f, polarity, threshold, {PART} AS part FROM rule_full) USING (f)
              WHERE split = 'test' GROUP BY person_id, f)""",
        FEATS,
        forest("full"),
    ),
}

# Clusters: ten starts for each k, all moved until they settle.

GRID = 'g AS (SELECT person_id, ' + ", ".join(f"round_even({c} * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS {c}" for c in _CLUSTER) + " FROM z)"
DISTANCE = " + ".join(f"(g.{c} - o.{c}) * (g.{c} - o.{c})" for c in _CLUSTER)
SAME = " AND ".join(f"abs(o.{c} - coalesce(m.{c}, o.{c})) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(coalesce(m.{c}, o.{c}))" for c in _CLUSTER)


def clusters(ks: str) -> str:
    """``final``: the centres of the best start for each k; ``n_2``: everybody's cluster for each k."""
    named = ", ".join(_CLUSTER)
    means = ", ".join(f"sum(round_even(g.{c} * 1e9::DOUBLE, 0)::BIGINT)::DOUBLE / count(*) / 1e9::DOUBLE AS {c}" for c in _CLUSTER)
    return f"""{_Z},
{GRID},
seed AS (
  SELECT start, cluster, {named} FROM (
    SELECT g.*, start, row_number() OVER (
      PARTITION BY start ORDER BY ('0x' || substr(md5(concat(person_id, ':', {SEED} + start)), 1, 8))::BIGINT, person_id) - 1 AS cluster
    FROM g, range(10) AS s(start)) WHERE cluster < 8),
lloyd AS (
  SELECT 0 AS i, k, start, cluster, {named}, FALSE AS done FROM seed JOIN (SELECT unnest({ks}) AS k) ON cluster < k
  UNION ALL
  SELECT o.i + 1, o.k, o.start, o.cluster, {", ".join(f"coalesce(m.{c}, o.{c})" for c in _CLUSTER)},
         bool_and({SAME}) OVER (PARTITION BY o.k, o.start)
  FROM lloyd o LEFT JOIN (
    SELECT k, start, (near).c AS cluster, {means}
    FROM (SELECT o.k, o.start, g.person_id, min({{'d': {DISTANCE}, 'c': o.cluster}}) AS near FROM lloyd o, g WHERE NOT o.done GROUP BY ALL)
    JOIN g USING (person_id) GROUP BY ALL) m USING (k, start, cluster)
  WHERE NOT o.done AND o.i < 300),
settled AS (
  SELECT l.* FROM lloyd l JOIN (SELECT k, start, max(i) - 1 AS i FROM lloyd GROUP BY ALL) USING (k, start, i)),
near AS (
  SELECT o.k, o.start, g.person_id, min({{'d': {DISTANCE}, 'c': o.cluster}}) AS near FROM settled o, g GROUP BY ALL),
cost AS (SELECT k, start, sum(round_even((near).d * 1e6::DOUBLE, 0)::BIGINT) AS inertia FROM near GROUP BY ALL),
final AS (
  SELECT k, start, inertia FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY inertia, start) AS r FROM cost) WHERE r = 1),
n_2 AS (SELECT k, person_id, (near).c AS cluster FROM near JOIN final USING (k, start))"""


_DOT = {v: "[" + ", ".join(f"list_dot_product(c[{i + 1}], {v})" for i in range(len(_CLUSTER))) + "]" for v in ("q1", "q2")}
_SCALED = "[" + ", ".join("{0}[" + str(i + 1) + "] / sqrt(list_dot_product({0}, {0}))" for i in range(len(_CLUSTER))) + "]"
_REST = "[" + ", ".join(f"y2[{i + 1}] - list_dot_product(n1, y2) * n1[{i + 1}]" for i in range(len(_CLUSTER))) + "]"
_SIGNED = "(CASE WHEN list_max([abs(x) FOR x IN {0}]) = list_max({0}) THEN 1 ELSE -1 END)"
AXES = f"""cov AS (
  SELECT [{", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in _CLUSTER) + "]" for a in _CLUSTER)}] AS c FROM g),
axis AS (
  SELECT 0 AS i, [{", ".join("1.0::DOUBLE" for _ in _CLUSTER)}] AS q1, [{", ".join("1.0::DOUBLE" if i % 2 == 0 else "-1.0::DOUBLE" for i, _ in enumerate(_CLUSTER))}] AS q2
  UNION ALL
  SELECT i + 1, n1, {_SCALED.format("r2")} FROM (
    SELECT *, {_REST} AS r2 FROM (
      SELECT *, {_SCALED.format("y1")} AS n1 FROM (
        SELECT i, {_DOT["q1"]} AS y1, {_DOT["q2"]} AS y2 FROM axis, cov WHERE i < 500)))),
axes AS (SELECT q1, q2, {_SIGNED.format("q1")} AS s1, {_SIGNED.format("q2")} AS s2 FROM axis WHERE i = 500)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def segmented(body: str, *extra: str) -> str:
    return recursive(with_parts("mart", body, clusters("[4]"), _NAMED, *extra))


SQL.update(
    {
        "kmeans_elbow": recursive(
            with_parts("mart", "SELECT k::INT AS k, inertia / 1e6::DOUBLE AS inertia FROM final", clusters("range(2, 9)"))
        ),
        "kmeans_segments": segmented("SELECT person_id, cluster::INT AS cluster, segment FROM seg"),
        "pca_projection": segmented(
            f"""SELECT person_id, segment, {r6("s1 * (" + " + ".join(f"g.{c} * q1[{i + 1}]" for i, c in enumerate(_CLUSTER)) + ")")} AS pca_x,
                       {r6("s2 * (" + " + ".join(f"g.{c} * q2[{i + 1}]" for i, c in enumerate(_CLUSTER)) + ")")} AS pca_y
                FROM (SELECT person_id, segment FROM seg) JOIN g USING (person_id), axes""",
            AXES,
        ),
        "segment_success": segmented(
            f"""SELECT segment, count(*) AS users, sum(is_successful)::BIGINT AS successful, {r6("avg(total_events)")} AS avg_events,
                       {r6("avg(tenure_days)")} AS avg_tenure, {pct("sum(is_successful)", "count(*)")} AS success_rate
                FROM seg GROUP BY segment"""
        ),
        "segment_sizes": segmented("SELECT segment, count(*) AS count FROM seg GROUP BY segment"),
        "segment_profile": segmented(f"SELECT segment, {_PROFILE} FROM seg GROUP BY segment"),
        "cluster_profile": segmented(f"SELECT cluster::INT AS cluster, {_PROFILE} FROM seg GROUP BY cluster"),
        "segment_radar": segmented(
            f"SELECT segment, {', '.join(f'{r6(f"avg({c})")} AS {c}' for c in _RADAR)} FROM seg GROUP BY segment"
        ),
        "segment_upgrade": segmented(
            f"""SELECT segment, count(*) AS users, {r1("avg(is_upgrade_candidate) * 100")} AS upgrade_rate,
                       {r1("avg(is_successful) * 100")} AS success_rate FROM seg GROUP BY segment"""
        ),
    }
)

# Boosted stumps, Newton steps, exchanged votes, and what follows from the early forest.


def boosted(tag: str, rounds: int) -> str:
    """``raw<n>``: everybody's score after n rounds, learned on the training split."""
    parts = [
        rows_of(tag),
        slots_of(tag, "split = 'train'"),
        f"""base AS (SELECT ln(avg(label) / (1 - avg(label))) AS base FROM row_{tag} WHERE split = 'train'),
raw0 AS (SELECT person_id, label, split, base AS raw FROM row_{tag}, base)""",
    ]
    for n in range(rounds):
        parts.append(f"""step{n} AS (
  SELECT person_id, round_even((p - label) * 1e7::DOUBLE, 0)::BIGINT AS g, round_even(p * (1 - p) * 1e7::DOUBLE, 0)::BIGINT AS h
  FROM (SELECT *, 1 / (1 + exp(-raw)) AS p FROM raw{n} WHERE split = 'train')),
sum{n} AS (
  SELECT f, slot, sum(g) AS g, sum(h) AS h FROM step{n} JOIN cell_{tag} USING (person_id) JOIN slot_{tag} USING (f, x) GROUP BY f, slot),
side{n} AS (
  SELECT f, slot, coalesce(sum(g) OVER w, 0) / 1e7::DOUBLE AS lg, coalesce(sum(h) OVER w, 0) / 1e7::DOUBLE AS lh,
         sum(g) OVER (PARTITION BY f) / 1e7::DOUBLE AS ag, sum(h) OVER (PARTITION BY f) / 1e7::DOUBLE AS ah, row_number() OVER (PARTITION BY f ORDER BY slot) AS place
  FROM sum{n} WINDOW w AS (PARTITION BY f ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut{n} AS (
  SELECT f, low AS threshold, -0.1::DOUBLE * lg / (lh + 1) AS below, -0.1::DOUBLE * (ag - lg) / (ah - lh + 1) AS above
  FROM side{n} JOIN edge_{tag} USING (f, slot) WHERE place > 1
  ORDER BY lg * lg / (lh + 1) + (ag - lg) * (ag - lg) / (ah - lh + 1) - ag * ag / (ah + 1) DESC, f, slot LIMIT 1),
raw{n + 1} AS (
  SELECT r.person_id, r.label, r.split, raw + CASE WHEN x >= threshold THEN above ELSE below END AS raw
  FROM raw{n} r, cut{n} JOIN cell_{tag} c USING (f) WHERE c.person_id = r.person_id)""")
    return ",\n".join(parts)


def boosted_query(tag: str, rounds: int) -> str:
    body = f"""SELECT person_id, label, {r6("1 / (1 + exp(-raw))")} AS probability, (1 / (1 + exp(-raw)) > 0.5)::INT AS prediction
               FROM raw{rounds} WHERE split = 'test'"""
    return with_parts("mart", body, FEATS, boosted(tag, rounds))


def newton(steps: int) -> str:
    """``beta<n>``: (i, b) after n steps, i = 0 for the intercept, by Gauss-Jordan elimination."""
    size = len(_EARLY) + 1
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END" for c in _EARLY
    )
    parts = [
        rows_of("early"),
        f"""wide AS (SELECT person_id, label, [1.0::DOUBLE, {scaled}] AS x FROM feats JOIN row_early USING (person_id) WHERE split = 'train'),
tall AS (SELECT person_id, label, unnest(x) AS x, unnest(range({size})) AS i FROM wide),
beta0 AS (SELECT range AS i, 0.0::DOUBLE AS b FROM range({size}))""",
    ]
    for n in range(steps):
        parts.append(f"""chance{n} AS (
  SELECT person_id, any_value(label) AS label, 1 / (1 + exp(-sum(x * b))) AS p FROM tall JOIN beta{n} USING (i) GROUP BY person_id),
elim{n}_0 AS (
  SELECT a.i, c.i AS j, sum(a.x * c.x * p * (1 - p)) + CASE WHEN a.i = c.i AND a.i > 0 THEN 1 ELSE 0 END AS v
  FROM tall a JOIN tall c USING (person_id) JOIN chance{n} USING (person_id) GROUP BY a.i, c.i
  UNION ALL
  SELECT i, {size}, sum(x * (h.label - p)) - CASE WHEN i > 0 THEN any_value(b) ELSE 0 END
  FROM tall JOIN chance{n} h USING (person_id) JOIN beta{n} USING (i) GROUP BY i)""")
        for k in range(size):
            parts.append(f"""elim{n}_{k + 1} AS (
  SELECT m.i, m.j, CASE WHEN m.i = {k} THEN m.v / d.v ELSE m.v - l.v * t.v / d.v END AS v
  FROM elim{n}_{k} m JOIN elim{n}_{k} l ON l.i = m.i AND l.j = {k} JOIN elim{n}_{k} t ON t.i = {k} AND t.j = m.j
  JOIN elim{n}_{k} d ON d.i = {k} AND d.j = {k})""")
        parts.append(f"beta{n + 1} AS (SELECT i, b + v AS b FROM beta{n} JOIN elim{n}_{size} USING (i) WHERE j = {size})")
    return ",\n".join(parts)


PERMUTED = f"""part AS (
  SELECT person_id, f, sum(CASE WHEN polarity * (x - threshold) >= 0 THEN n ELSE 0 END) AS v
  FROM cell_full JOIN same_full USING (f) GROUP BY person_id, f),
place AS (
  SELECT person_id, label, row_number() OVER (ORDER BY key, person_id) AS here,
         row_number() OVER (ORDER BY ('0x' || substr(md5(concat(person_id, ':{SEED}')), 1, 8))::BIGINT, person_id) AS there
  FROM row_full WHERE split = 'test'),
swapped AS (
  SELECT a.person_id, a.label, f.f, coalesce(y.v, 0) - coalesce(x.v, 0) AS change
  FROM place a JOIN place b ON b.there = a.here CROSS JOIN (SELECT range AS f FROM range({len(FULL)})) f
  LEFT JOIN part x ON x.person_id = a.person_id AND x.f = f.f LEFT JOIN part y ON y.person_id = b.person_id AND y.f = f.f
  UNION ALL SELECT person_id, label, -1, 0 FROM place),
whole AS (SELECT person_id, sum(v) AS v FROM part GROUP BY person_id),
judged AS (SELECT f, label, v + change AS p FROM swapped JOIN whole USING (person_id)),
lost AS (
  SELECT f, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
  FROM (SELECT * FROM judged WHERE label = 1) a JOIN (SELECT * FROM judged WHERE label = 0) b USING (f) GROUP BY f)"""

SQL.update(
    {
        "boosted_stumps_early": boosted_query("early", 3),
        "boosted_stumps": boosted_query("full", 3),
        "newton_coefficients": with_parts(
            "mart",
            f"""SELECT {"['', " + ", ".join(f"'{c}'" for c in _EARLY) + "]"}[i + 1] AS feature, {r6("b")} AS coefficient FROM beta3""",
            FEATS,
            newton(3),
        ),
        "vote_permutation": with_parts(
            "mart",
            f"""SELECT {NAMES}[f + 1] AS feature, {r6("(SELECT auc FROM lost WHERE f = -1) - auc")} AS auc_loss FROM lost WHERE f >= 0""",
            FEATS,
            forest("full"),
            PERMUTED,
        ),
        "business_case": with_parts(
            "mart",
            f"""SELECT high_risk_users, {r6("recovery")} AS recovery_rate,
                       CAST(trunc(high_risk_users * recovery * 0.10::DOUBLE) AS BIGINT) AS estimated_recoveries,
                       u.candidates AS upgrade_candidates, u.pct AS upgrade_pct
                FROM (SELECT count(*) FILTER (WHERE risk_flag = '🔴 High Risk') AS high_risk_users FROM risk),
                     (SELECT (avg(success_rate) FILTER (WHERE milestones_hit >= 4)
                              - coalesce(max(success_rate) FILTER (WHERE milestones_hit = 0), 0.0::DOUBLE)) / 100 AS recovery
                      FROM ({RELATIONAL["success_by_milestones"]})), ({RELATIONAL["upgrade_candidates"]}) u""",
            FEATS,
            forest("early"),
            RISK,
        ),
    }
)
