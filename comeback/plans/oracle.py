"""The catalogue's queries as plain SQL for DuckDB, written without the rollup.

Each text is self-contained: common table expressions from ``_PARTS`` up to the one it needs,
then the report itself.
"""

from __future__ import annotations

from comeback.plans.testlog import PERSON_LIMITS, TEST_SETTINGS, TEST_TAXONOMY


def _names(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_T = TEST_TAXONOMY
_PERSON = " ".join(f"WHEN k < {limit} THEN {i}" for i, limit in enumerate(PERSON_LIMITS))

_LOG = f"""log AS (
  SELECT event_id AS uuid, ts, user_id * 10 + CASE {_PERSON} ELSE {len(PERSON_LIMITS)} END AS person_id,
         concat(event_type, '_', CAST(event_id % 4 AS VARCHAR)) AS event,
         CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Windows ' WHEN 2 THEN 'Windows'
              WHEN 3 THEN 'Mac OS X' WHEN 4 THEN 'Mac OS X' ELSE 'Linux' END AS raw_os
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""

_DIRTY = """bad AS (
  SELECT uuid, person_id, event, raw_os,
         CASE WHEN uuid % 101 = 0 THEN 'not-a-date' ELSE CAST(ts AS VARCHAR) END AS stamp
  FROM log),
dirty AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE uuid % 10 = 3)"""

_FLAGS = ", ".join(
    f"CAST(event IN {_names(names)} AS INT) AS is_{kind}_event" for kind, names in _T.categories().items()
)

_EV = f"""ev AS (
  SELECT *, trim(coalesce(raw_os, 'Unknown')) AS os, CAST(ts AS DATE) AS day, hour(ts) AS h,
         CAST(weekofyear(ts) AS INT) AS week,
         CAST(date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', ts) AS DATE)) // 7 AS INT) AS week_key,
         {_FLAGS}, CAST(event IN {_names(_T.signup)} AS INT) AS is_signup
  FROM log)"""

_OFF = """ppl AS (SELECT person_id, min(ts) AS first_ts, min(week_key) AS first_week FROM ev GROUP BY person_id),
off AS (
  SELECT ev.*, first_ts, first_week,
         CAST(floor((epoch_us(ts) - epoch_us(first_ts)) / 86400000000) AS BIGINT) AS days_since_first,
         CAST(week_key - first_week AS INT) AS weeks_since_first
  FROM ev JOIN ppl USING (person_id))"""


def _window(prefix: str, days: int, kinds: tuple[str, ...]) -> str:
    inside = f"FILTER (WHERE days_since_first <= {days})"
    sums = ", ".join(
        f"coalesce(sum(is_{kind}_event) {inside}, 0)::BIGINT AS {prefix}_{kind}_events" for kind in kinds
    )
    return (
        f"count(uuid) {inside} AS {prefix}_total_events, {sums}, "
        f"count(DISTINCT event) {inside} AS {prefix}_unique_events, "
        f"count(DISTINCT day) {inside} AS {prefix}_active_days"
    )


_KINDS = tuple(_T.categories())
_SUMS = ", ".join(f"sum(is_{kind}_event)::BIGINT AS {kind}_events" for kind in _KINDS)
_RATIOS = ", ".join(f"{kind}_events / (total_events + 1) AS {kind}_ratio" for kind in _KINDS)


def _ever(names: tuple[str, ...], alias: str) -> str:
    return f"max(CAST(event IN {_names(names)} AS INT)) AS {alias}"


_AGG = f"""agg AS (
  SELECT person_id, count(uuid) AS total_events, count(DISTINCT event) AS unique_event_types,
         min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT day) AS active_days,
         count(DISTINCT week_key) AS active_weeks, {_SUMS},
         {_window("fw", 7, _KINDS)}, {_window("d3", 3, ("agent", "production", "canvas"))},
         {_ever((_T.published,), "ever_published_app")}, {_ever((_T.scheduled,), "ever_scheduled")},
         {_ever((_T.shared,), "ever_shared")}, {_ever((_T.addon,), "used_addon_credits")},
         {_ever(_T.upgrade, "is_upgrade_candidate")},
         min(ts) FILTER (WHERE is_agent_event = 1) AS first_agent_ts,
         min(ts) FILTER (WHERE is_production_event = 1) AS first_value_ts,
         CAST(hour(min(ts) FILTER (WHERE is_signup = 1)) AS INT) AS signup_hour
  FROM off GROUP BY person_id)"""

_FIRST_EVENT = """first_events AS (
  SELECT person_id, event AS first_event FROM (
    SELECT person_id, event, row_number() OVER (PARTITION BY person_id ORDER BY ts, event) AS rn FROM ev)
  WHERE rn = 1)"""

_OS_MODE = """os_mode AS (
  SELECT person_id, os AS os_platform FROM (
    SELECT person_id, os, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, os) AS rn
    FROM ev GROUP BY person_id, os)
  WHERE rn = 1)"""

_FEAT = f"""feat AS (
  SELECT *, CAST(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000) AS BIGINT) AS tenure_days,
         total_events / (active_days + 1) AS events_per_day, {_RATIOS},
         unique_event_types / max(unique_event_types) OVER () AS event_diversity,
         active_days / (active_weeks + 1) AS weekly_cadence,
         (epoch_us(first_agent_ts) - epoch_us(first_seen)) / 1e6 / 3600 AS hours_to_first_agent,
         (epoch_us(first_value_ts) - epoch_us(first_seen)) / 1e6 / 3600 AS hours_to_first_value,
         CAST(production_events > 0 AS INT) AS did_run_code, CAST(agent_events > 0 AS INT) AS did_use_agent,
         ever_published_app AS did_publish, CAST(active_weeks >= 2 AS INT) AS did_return_week2,
         CAST(unique_event_types >= {TEST_SETTINGS.diverse_event_types} AS INT) AS did_diverse_events
  FROM agg)"""


def _scaled(column: str) -> str:
    low, high = f"min({column}) OVER ()", f"max({column}) OVER ()"
    return f"(({column} - {low}) / CASE WHEN {high} = {low} THEN 1.0::DOUBLE ELSE ({high} - {low})::DOUBLE END)"


def _score(columns: tuple[str, ...]) -> str:
    return "((" + " + ".join(_scaled(c) for c in columns) + f") / {len(columns)}) * 100"


# Fixed values, as in the operators.
_RETENTION = ("tenure_days", "active_days", "active_weeks", "events_per_day", "weekly_cadence")
_DEPTH = (
    "agent_ratio",
    "production_ratio",
    "collab_ratio",
    "event_diversity",
    "ever_published_app",
    "ever_scheduled",
    "ever_shared",
)
_VOLUME = ("total_events", "unique_event_types", "credit_events")

_MART = f"""parts AS (
  SELECT *, {_score(_RETENTION)} AS retention_score, {_score(_DEPTH)} AS depth_score,
         {_score(_VOLUME)} AS volume_score
  FROM feat),
scored AS (
  SELECT *, 0.40::DOUBLE * retention_score + 0.35::DOUBLE * depth_score + 0.25::DOUBLE * volume_score
         AS success_score
  FROM parts),
cut AS (SELECT quantile_cont(success_score, 0.7) AS threshold FROM scored),
mart AS (
  SELECT scored.*, threshold, first_event, os_platform,
         CAST(success_score >= threshold AS INT) AS is_successful,
         did_run_code + did_use_agent + did_publish + did_return_week2 + did_diverse_events AS milestones_hit,
         CASE WHEN hours_to_first_agent IS NULL THEN '4_Never Used Agent'
              WHEN hours_to_first_agent <= 2 THEN '1_Within 2 Hours'
              WHEN hours_to_first_agent <= 24 THEN '2_Within 24 Hours' ELSE '3_After 24 Hours' END AS agent_speed,
         CASE WHEN hours_to_first_value IS NULL THEN '5_Never' WHEN hours_to_first_value <= 1 THEN '1_Under 1h'
              WHEN hours_to_first_value <= 24 THEN '2_Under 24h'
              WHEN hours_to_first_value <= 72 THEN '3_Under 72h' ELSE '4_After 72h' END AS ttv_bucket,
         CASE WHEN signup_hour IS NULL THEN 'Unknown' WHEN signup_hour BETWEEN 6 AND 11 THEN '🌅 Morning (6-12)'
              WHEN signup_hour BETWEEN 12 AND 17 THEN '☀️ Afternoon (12-18)'
              WHEN signup_hour BETWEEN 18 AND 23 THEN '🌆 Evening (18-24)'
              ELSE '🌙 Night (0-6)' END AS signup_period
  FROM scored CROSS JOIN cut JOIN first_events USING (person_id) JOIN os_mode USING (person_id))"""

# Cohort tables on top of the offsets.
_COHORT = """sizes AS (
  SELECT first_week AS cohort, count(*) AS cohort_size,
         CAST(weekofyear(DATE '1970-01-05' + CAST(first_week * 7 AS INT)) AS INT) AS signup_week
  FROM ppl GROUP BY first_week),
ret AS (
  SELECT cohort, signup_week, weeks_since_first AS week_offset, users, cohort_size,
         round_even(users / cohort_size * 100 * 10, 0) / 10 AS retention_rate
  FROM (SELECT first_week AS cohort, weeks_since_first, count(DISTINCT person_id) AS users FROM off
        WHERE weeks_since_first BETWEEN 0 AND 12 GROUP BY ALL) JOIN sizes USING (cohort)),
curve AS (SELECT week_offset, round_even(avg(retention_rate) * 1e6, 0) / 1e6 AS avg_rate FROM ret GROUP BY 1)"""

_PARTS = (
    ("log", _LOG),
    ("dirty", _DIRTY),
    ("ev", _EV),
    ("off", _OFF),
    ("mart", ",\n".join([_AGG, _FIRST_EVENT, _OS_MODE, _FEAT, _MART])),
)
_NEEDS = {
    "log": ("log",),
    "dirty": ("log", "dirty"),
    "ev": ("log", "ev"),
    "off": ("log", "ev", "off"),
    "mart": ("log", "ev", "off", "mart"),
}


def with_parts(upto: str, body: str, *extra: str) -> str:
    texts = dict(_PARTS)
    return "WITH " + ",\n".join([texts[p] for p in _NEEDS[upto]] + list(extra)) + "\n" + body


def r6(expression: str) -> str:
    return f"round_even(({expression}) * 1e6, 0) / 1e6"


def r1(expression: str) -> str:
    return f"round_even(({expression}) * 10, 0) / 10"


def pct(part: str, whole: str) -> str:
    return r1(f"{part} / {whole} * 100")


def wilson(successes: str, trials: str) -> str:
    p, n, z2 = f"({successes} / {trials})", f"{trials}", "(1.96::DOUBLE * 1.96::DOUBLE)"
    scale = f"(1 + {z2} / {n})"
    centre = f"(({p} + {z2} / (2 * {n})) / {scale})"
    margin = (
        f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / {scale})"
    )
    return f"{r1(f'({centre} - {margin}) * 100')} AS ci_lo, {r1(f'({centre} + {margin}) * 100')} AS ci_hi"


def rate(key: str, users: str = "users", where: str = "TRUE", having: str = "TRUE", extra: str = "") -> str:
    inner = (
        f"SELECT {key}, count(*) AS {users}, sum(is_successful)::BIGINT AS successful FROM mart "
        f"WHERE {where} GROUP BY {key} HAVING {having}"
    )
    return f"SELECT *, {pct('successful', users)} AS success_rate{extra} FROM ({inner})"


def unpivot(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


_MILESTONES = (
    ("did_run_code", "Ran Code"),
    ("did_use_agent", "Used Agent"),
    ("did_publish", "Published App"),
    ("did_return_week2", "Returned Week 2"),
    ("did_diverse_events", "10+ Event Types"),
)


def _lift(outcome: str) -> str:
    rows = []
    for i, (column, label) in enumerate(_MILESTONES, start=1):
        hit, miss = (
            r1(f"avg({outcome}) FILTER (WHERE {column} = {value}) * 100") for value in (1, 0)
        )
        rows.append(
            f"SELECT {i}::INT AS position, '{label}' AS milestone, {hit} AS hit_rate, {miss} AS miss_rate FROM mart"
        )
    return unpivot(rows)


def _means(columns: tuple[str, ...]) -> str:
    rows = []
    for i, column in enumerate(columns, start=1):
        low, high = (r6(f"avg({column}) FILTER (WHERE is_successful = {v})") for v in (0, 1))
        rows.append(
            f"SELECT {i}::INT AS position, '{column}' AS feature, {low} AS unsuccessful, {high} AS successful FROM mart"
        )
    return unpivot(rows)


_CATEGORIES = (
    ("agent", "Agent Events"),
    ("production", "Production Events"),
    ("canvas", "Canvas Events"),
    ("collab", "Collab Events"),
    ("credit", "Credit Events"),
)
_NO_CATEGORY = " AND ".join(f"is_{kind}_event = 0" for kind in _KINDS)
_CATEGORY_ROWS = [
    f"SELECT {i}::INT AS position, '{label}' AS category, sum(is_{kind}_event)::BIGINT AS count FROM ev"
    for i, (kind, label) in enumerate(_CATEGORIES, start=1)
] + [f"SELECT 6::INT, 'Other', count(*) FILTER (WHERE {_NO_CATEGORY}) FROM ev"]

_STAGES = (
    ("1. Signed Up", "TRUE"),
    ("2. Opened a Canvas", f"{_T.opened_canvas}_n > 0"),
    ("3. Created a Block", f"{_T.created_block}_n > 0"),
    ("4. Used Agent", "agent_events > 0"),
    ("5. Ran Code", "production_events > 0"),
    ("6. Active 7+ Days", "tenure_days >= 7"),
    ("7. Published / Scheduled", "ever_published_app = 1 OR ever_scheduled = 1"),
    ("8. Successful (Top 30%)", "is_successful = 1"),
)
_STAGE_EVENTS = f"""opened AS (
  SELECT person_id, count(*) FILTER (WHERE event = '{_T.opened_canvas}') AS {_T.opened_canvas}_n,
         count(*) FILTER (WHERE event = '{_T.created_block}') AS {_T.created_block}_n
  FROM ev GROUP BY person_id),
stages AS (
  SELECT *, {pct("users", "first_value(users) OVER (ORDER BY position)")} AS pct_of_first FROM (
  {unpivot([
      f"SELECT {i}::INT AS position, '{label}' AS stage, count(*) FILTER (WHERE {test}) AS users "
      f"FROM mart JOIN opened USING (person_id)"
      for i, (label, test) in enumerate(_STAGES, start=1)
  ])}))"""

_EVENT_NAMES = sorted(f"{kind}_{i}" for kind in ("click", "error", "purchase", "signup", "view") for i in range(4))
_MATRIX = ", ".join(f"count(*) FILTER (WHERE event = '{name}') AS evt_{name}" for name in _EVENT_NAMES)

_FW = ", ".join(
    ["fw_total_events", *[f"fw_{kind}_events" for kind in _KINDS], "fw_unique_events", "fw_active_days"]
)
_COUNTS = ", ".join(f"{kind}_events" for kind in _KINDS)
_ROUNDED = ", ".join(
    f"{r6(c)} AS {c}"
    for c in ("events_per_day", *[f"{kind}_ratio" for kind in _KINDS], "event_diversity", "weekly_cadence")
)


def _weekly(where: str, alias: str = "events") -> str:
    return with_parts(
        "ev", f"SELECT week_key, week, count(*) AS {alias} FROM ev WHERE {where} GROUP BY week_key, week"
    )


SQL: dict[str, str] = {
    "dataset_profile": with_parts(
        "dirty",
        """SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, count(DISTINCT person_id) AS n_users,
                  count(DISTINCT event) AS n_events, min(try_cast(stamp AS TIMESTAMP)) AS first_timestamp,
                  max(try_cast(stamp AS TIMESTAMP)) AS last_timestamp,
                  count_if(try_cast(stamp AS TIMESTAMP) IS NULL)::BIGINT AS bad_timestamps FROM dirty""",
    ),
    "clean_events": with_parts(
        "dirty",
        """SELECT DISTINCT uuid, person_id, event, t AS event_time, trim(coalesce(raw_os, 'Unknown')) AS os,
                  CAST(t AS DATE) AS date, hour(t)::INT AS hour, dayname(t) AS dow, weekofyear(t)::INT AS week,
                  month(t)::INT AS month
           FROM (SELECT *, try_cast(stamp AS TIMESTAMP) AS t FROM dirty) WHERE t IS NOT NULL""",
    ),
    "dedupe_report": with_parts(
        "dirty",
        """SELECT count(*) AS rows_before, count(DISTINCT uuid) AS rows_after,
                  count(*) - count(DISTINCT uuid) AS removed FROM dirty""",
    ),
    "event_flags": with_parts(
        "ev",
        "SELECT uuid, event, "
        + ", ".join(f"is_{kind}_event" for kind in _KINDS)
        + f", is_signup, CAST({_NO_CATEGORY} AS INT) AS is_other FROM ev",
    ),
    "event_offsets": with_parts("off", "SELECT uuid, person_id, days_since_first, weeks_since_first FROM off"),
    "event_frequency": with_parts("ev", "SELECT event, count(*) AS count FROM ev GROUP BY event"),
    "top_events": with_parts(
        "ev", "SELECT event, count(*) AS count FROM ev GROUP BY event ORDER BY count DESC, event LIMIT 15"
    ),
    "category_breakdown": with_parts("ev", unpivot(_CATEGORY_ROWS)),
    "weekly_events": _weekly("TRUE"),
    "weekly_active_users": with_parts(
        "ev", "SELECT week_key, week, count(DISTINCT person_id) AS users FROM ev GROUP BY week_key, week"
    ),
    "weekly_signups": _weekly("is_signup = 1", "signups"),
    "weekly_new_accounts": _weekly(f"event = '{_T.account_created}'", "signups"),
    "weekly_agent_events": _weekly("is_agent_event = 1"),
    "hourly_events": with_parts("ev", "SELECT h::INT AS hour, count(*) AS events FROM ev GROUP BY 1"),
    "weekday_events": with_parts(
        "ev",
        """SELECT position::INT AS position, dow, events
           FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
                        (6, 'Saturday'), (7, 'Sunday')) AS days(position, dow)
           LEFT JOIN (SELECT dayname(ts) AS dow, count(*) AS events FROM ev GROUP BY 1) USING (dow)""",
    ),
    "os_distribution": with_parts(
        "ev", "SELECT os, count(*) AS count FROM ev GROUP BY os ORDER BY count DESC, os LIMIT 6"
    ),
    "user_features": with_parts(
        "mart",
        f"""SELECT person_id, total_events, unique_event_types, first_seen, last_seen, active_days, active_weeks,
                   {_COUNTS}, tenure_days, {_ROUNDED}, ever_published_app, ever_scheduled, ever_shared,
                   used_addon_credits, is_upgrade_candidate FROM mart""",
    ),
    "first_week_features": with_parts("mart", f"SELECT person_id, {_FW} FROM mart"),
    "day3_features": with_parts(
        "mart",
        """SELECT person_id, d3_total_events, d3_agent_events, d3_production_events, d3_canvas_events,
                  d3_unique_events, d3_active_days FROM mart""",
    ),
    "user_event_matrix": with_parts("ev", f"SELECT person_id, {_MATRIX} FROM ev GROUP BY person_id"),
    "user_os_mode": with_parts("mart", "SELECT person_id, os_platform FROM mart"),
    "first_event": with_parts("mart", "SELECT person_id, first_event FROM mart"),
    "signup_hour": with_parts("mart", "SELECT person_id, signup_hour, signup_period FROM mart"),
    "user_milestones": with_parts(
        "mart",
        """SELECT person_id, did_run_code, did_use_agent, did_publish, did_return_week2, did_diverse_events,
                  milestones_hit FROM mart""",
    ),
    "first_agent_time": with_parts(
        "mart",
        f"""SELECT person_id, first_agent_ts, {r6("hours_to_first_agent")} AS hours_to_first_agent, agent_speed
            FROM mart""",
    ),
    "first_value_time": with_parts(
        "mart",
        f"""SELECT person_id, first_value_ts, {r6("hours_to_first_value")} AS hours_to_first_value, ttv_bucket
            FROM mart""",
    ),
    "user_scores": with_parts(
        "mart",
        "SELECT person_id, "
        + ", ".join(f"{r6(c)} AS {c}" for c in ("retention_score", "depth_score", "volume_score", "success_score"))
        + ", is_successful FROM mart",
    ),
    "success_summary": with_parts(
        "mart",
        f"""SELECT count(*) AS users, sum(is_successful)::BIGINT AS successful,
                   {r6("max(threshold)")} AS threshold FROM mart""",
    ),
    "success_by_agent_speed": with_parts(
        "mart", rate("agent_speed", "total_users", extra=", " + wilson("successful", "total_users"))
    ),
    "success_by_time_to_value": with_parts("mart", rate("ttv_bucket")),
    "success_by_milestones": with_parts("mart", rate("milestones_hit")),
    "milestone_lift": with_parts("mart", _lift("is_successful")),
    "milestone_upgrade_lift": with_parts("mart", _lift("is_upgrade_candidate")),
    "success_by_first_event": with_parts(
        "mart", rate("first_event", having="count(*) >= 5") + " ORDER BY success_rate DESC, first_event LIMIT 12"
    ),
    "success_by_os": with_parts("mart", rate("os_platform", having="count(*) >= 5")),
    "success_by_signup_period": with_parts("mart", rate("signup_period", where="signup_period <> 'Unknown'")),
    "success_by_first_week_days": with_parts(
        "mart",
        f"SELECT fw_active_days, {r6('avg(is_successful)')} AS success_rate FROM mart GROUP BY fw_active_days",
    ),
    "sharing_effect": with_parts(
        "mart",
        f"""SELECT CASE ever_shared WHEN 1 THEN 'Shared Canvas' ELSE 'Never Shared' END AS label, users, successful,
                   upgrade_cands, {pct("successful", "users")} AS success_rate,
                   {pct("upgrade_cands", "users")} AS upgrade_rate
            FROM (SELECT ever_shared, count(*) AS users, sum(is_successful)::BIGINT AS successful,
                         sum(is_upgrade_candidate)::BIGINT AS upgrade_cands FROM mart GROUP BY ever_shared)""",
    ),
    "publish_effect": with_parts("mart", rate("ever_published_app", extra=", " + wilson("successful", "users"))),
    "publish_contingency": with_parts(
        "mart", "SELECT ever_published_app, is_successful, count(*) AS users FROM mart GROUP BY ALL"
    ),
    "upgrade_candidates": with_parts(
        "mart",
        f"""SELECT *, {pct("candidates", "users")} AS pct
            FROM (SELECT count(*) AS users, sum(is_upgrade_candidate)::BIGINT AS candidates FROM mart)""",
    ),
    "one_time_visitors": with_parts(
        "mart",
        f"""SELECT *, printf('%.1f', pct) || '% of users' AS pct_text
            FROM (SELECT *, {pct("one_time_users", "users")} AS pct
                  FROM (SELECT count(*) AS users, count(*) FILTER (WHERE total_events <= 5) AS one_time_users
                        FROM mart))""",
    ),
    "feature_means_by_label": with_parts(
        "mart",
        _means(
            (
                "total_events",
                "active_days",
                "tenure_days",
                "agent_events",
                "production_events",
                "collab_events",
                "ever_published_app",
                "ever_scheduled",
                "used_addon_credits",
            )
        ),
    ),
    "first_week_means_by_label": with_parts(
        "mart",
        _means(
            (
                "fw_total_events",
                "fw_agent_events",
                "fw_production_events",
                "fw_canvas_events",
                "fw_unique_events",
                "fw_active_days",
            )
        ),
    ),
    "score_histogram": with_parts(
        "mart",
        """SELECT bin, count(*) AS users FROM (
             SELECT least(floor((success_score - min(success_score) OVER ())
                    / (max(success_score) OVER () - min(success_score) OVER ()) * 60), 59)::INT AS bin FROM mart)
           GROUP BY bin""",
    ),
    "agent_histogram_by_label": with_parts(
        "mart",
        """SELECT is_successful, least(floor(greatest(0, least(agent_events, 200)) * 50 / 200), 49)::INT AS bin,
                  count(*) AS users FROM mart GROUP BY ALL""",
    ),
    "volume_correlation": with_parts(
        "mart",
        f"""SELECT {r6("a")} AS corr_volume, {r6("b")} AS corr_first_week,
                   round_even(b / greatest(abs(a), 0.001) * 1e4, 0) / 1e4 AS times_stronger
            FROM (SELECT corr(total_events, is_successful) AS a, corr(fw_active_days, is_successful) AS b
                  FROM mart)""",
    ),
    "cohort_sizes": with_parts("off", "SELECT cohort, signup_week, cohort_size FROM sizes", _COHORT),
    "cohort_retention": with_parts("off", "SELECT * FROM ret", _COHORT),
    "cohort_matrix": with_parts(
        "off",
        "SELECT cohort, signup_week, "
        + ", ".join(
            f"coalesce(max(retention_rate) FILTER (WHERE week_offset = {i}), 0.0::DOUBLE) AS w{i}" for i in range(13)
        )
        + " FROM ret WHERE cohort_size >= 5 GROUP BY cohort, signup_week",
        _COHORT,
    ),
    "avg_retention_curve": with_parts("off", "SELECT week_offset, avg_rate FROM curve", _COHORT),
    "avg_retention_curve_dense": with_parts(
        "off",
        f"""SELECT week_offset, {r6("sum(retention_rate) / (SELECT count(DISTINCT cohort) FROM ret)")} AS avg_rate
            FROM ret GROUP BY week_offset""",
        _COHORT,
    ),
    "retention_cliff": with_parts(
        "off",
        f"""SELECT week_offset, avg_rate, {r6("change")} AS change
            FROM (SELECT *, avg_rate - lag(avg_rate) OVER (ORDER BY week_offset) AS change FROM curve)
            WHERE change IS NOT NULL ORDER BY change, week_offset LIMIT 1""",
        _COHORT,
    ),
    "survival_curve": with_parts(
        "off",
        f"""SELECT week, active, pct, repeat('#', CAST(floor(pct / 5) AS INT)) AS bar
            FROM (SELECT *, {pct("active", "total")} AS pct
                  FROM (SELECT w::INT AS week,
                               (SELECT count(DISTINCT person_id) FROM off WHERE weeks_since_first >= w) AS active,
                               (SELECT count(DISTINCT person_id) FROM off) AS total
                        FROM range(13) AS weeks(w)))""",
    ),
    "daily_cumulative_events": with_parts(
        "mart",
        """SELECT is_successful, days_since_first,
                  (sum(n) OVER (PARTITION BY is_successful ORDER BY days_since_first))::BIGINT AS events
           FROM (SELECT is_successful, days_since_first, count(*) AS n FROM off JOIN mart USING (person_id)
                 WHERE days_since_first <= 30 GROUP BY ALL)""",
    ),
    "user_funnel": with_parts(
        "mart",
        """SELECT position, stage, users, pct_of_first, printf('%.1f', pct_of_first) || '% of signups' AS pct_text
           FROM stages""",
        _STAGE_EVENTS,
    ),
    "headline_numbers": with_parts(
        "mart",
        f"""SELECT users, one_time_pct,
                   (SELECT success_rate FROM publish WHERE ever_published_app = 1) AS publisher_rate,
                   (SELECT success_rate FROM publish WHERE ever_published_app = 0) AS other_rate,
                   (SELECT success_rate FROM speed WHERE agent_speed = '1_Within 2 Hours') AS fast_rate,
                   (SELECT success_rate FROM speed WHERE agent_speed = '3_After 24 Hours') AS patient_rate,
                   (SELECT ci_lo FROM speed WHERE agent_speed = '3_After 24 Hours') AS patient_lo,
                   (SELECT ci_hi FROM speed WHERE agent_speed = '3_After 24 Hours') AS patient_hi
            FROM (SELECT count(*) AS users,
                         {r1("count(*) FILTER (WHERE total_events <= 5) / count(*) * 100")} AS one_time_pct FROM mart)""",
        f"speed AS ({rate('agent_speed', extra=', ' + wilson('successful', 'users'))})",
        f"publish AS ({rate('ever_published_app')})",
    ),
    "funnel_dropoff": with_parts(
        "mart",
        f"""SELECT position, from_stage, to_stage, lost,
                   coalesce(CASE WHEN prev > 0 THEN {pct("lost", "prev")} END, 0.0::DOUBLE) AS pct_lost
            FROM (SELECT position, lag(stage) OVER w AS from_stage, stage AS to_stage, lag(users) OVER w AS prev,
                         lag(users) OVER w - users AS lost FROM stages WINDOW w AS (ORDER BY position))
            WHERE from_stage IS NOT NULL""",
        _STAGE_EVENTS,
    ),
}

SQL["user_funnel_of_3_names"] = SQL["user_funnel"]
SQL["stored_report"] = SQL["success_by_agent_speed"]
for _count in (20, 30):
    SQL[f"top_{_count}_events"] = with_parts(
        "ev", f"SELECT event, count(*) AS count FROM ev GROUP BY event ORDER BY count DESC, event LIMIT {_count}"
    )
SQL["read_log"] = with_parts("ev", "SELECT uuid, person_id, event, ts AS event_time, raw_os AS os FROM ev")
SQL["log_head"] = SQL["read_log"] + " ORDER BY uuid LIMIT 5"
SQL["score_histogram_dense"] = with_parts(
    "mart",
    """SELECT r.bin::INT AS bin, count(m.bin) AS users FROM range(60) AS r(bin) LEFT JOIN (
         SELECT least(floor((success_score - min(success_score) OVER ())
                / (max(success_score) OVER () - min(success_score) OVER ()) * 60), 59)::INT AS bin FROM mart) m USING (bin)
       GROUP BY r.bin""",
)

_KEY = "CAST('0x' || substr(md5(CAST(person_id AS VARCHAR) || ':0'), 1, 8) AS BIGINT)"
_RANKED = f"""ranked AS (
  SELECT person_id, is_successful AS label, row_number() OVER (PARTITION BY is_successful ORDER BY {_KEY}, person_id) AS rn,
         count(*) OVER (PARTITION BY is_successful) AS size,
         row_number() OVER (ORDER BY {_KEY}, person_id) AS rn_all, count(*) OVER () AS all_size
  FROM mart)"""

SQL["volume_points"] = with_parts(
    "mart",
    f"""SELECT person_id, is_successful, {r6("ln(1 + total_events)")} AS log_events
        FROM mart JOIN (SELECT person_id, rn FROM ranked) USING (person_id) WHERE rn <= 800""",
    _RANKED,
)
SQL["retention_depth_points"] = with_parts(
    "mart",
    f"""SELECT person_id, is_successful, {r6("retention_score")} AS retention_score, {r6("depth_score")} AS depth_score,
               greatest(1, least(total_events, 500))::BIGINT AS size
        FROM mart JOIN (SELECT person_id, rn FROM ranked) USING (person_id) WHERE rn <= 1500""",
    _RANKED,
)

# Fixed values, as in the operators.
_CLUSTER = (
    "total_events",
    "active_days",
    "tenure_days",
    "retention_score",
    "depth_score",
    "volume_score",
    "agent_ratio",
    "production_ratio",
    "ever_published_app",
    "ever_scheduled",
    "used_addon_credits",
)
_Z = f"""z AS (SELECT person_id, {", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}"
    for c in _CLUSTER
)} FROM mart)"""

# Fixed values, as in the operators.
_EARLY = (
    "d3_total_events",
    "d3_agent_events",
    "d3_production_events",
    "d3_canvas_events",
    "d3_unique_events",
    "d3_active_days",
)
_STUMP_PARTS = f"""cells AS ({unpivot([
    f"SELECT {i} AS feature_no, '{c}' AS feature, {c}::DOUBLE AS x, is_successful AS label FROM mart"
    for i, c in enumerate(_EARLY)
])}),
cuts AS (SELECT DISTINCT feature_no, feature, x AS threshold FROM cells),
rules AS (
  SELECT feature_no, feature, threshold, polarity,
         count(*) FILTER (WHERE CAST(polarity * (x - threshold) >= 0 AS INT) <> label) AS errors, count(*) AS n
  FROM cuts JOIN cells USING (feature_no, feature) CROSS JOIN (VALUES (1), (-1)) AS p(polarity) GROUP BY ALL)"""

_WEIGHTED_STUMP = f"""cells AS ({unpivot([
    f"SELECT {i} AS feature_no, '{c}' AS feature, {c}::DOUBLE AS x, is_successful AS label, "
    "(CASE WHEN person_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1 / (d3_total_events + 1.0::DOUBLE) END)::DECIMAL(20, 9) AS w FROM mart"
    for i, c in enumerate(_EARLY)
])}),
cuts AS (SELECT DISTINCT feature_no, feature, x AS threshold FROM cells),
rules AS (
  SELECT feature_no, feature, threshold, polarity,
         coalesce(sum(w) FILTER (WHERE CAST(polarity * (x - threshold) >= 0 AS INT) <> label), 0) AS errors, sum(w) AS n
  FROM cuts JOIN cells USING (feature_no, feature) CROSS JOIN (VALUES (1), (-1)) AS p(polarity) GROUP BY ALL)"""

_SCORED = """scores AS (
  SELECT person_id, is_successful AS label, d3_agent_events / (d3_total_events + 1) AS p FROM mart),
confused AS (
  SELECT count(*) FILTER (WHERE p > 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE p > 0.3 AND label = 0) AS fp,
         count(*) FILTER (WHERE p <= 0.3 AND label = 1) AS fn, count(*) FILTER (WHERE p <= 0.3 AND label = 0) AS tn
  FROM scores)"""


def r4(expression: str) -> str:
    return f"round_even(({expression}) * 1e4, 0) / 1e4"


_PREC, _REC = "(tp / greatest(tp + fp, 1))", "(tp / greatest(tp + fn, 1))"
_RATES = (
    f"{r4(_PREC)} AS precision, {r4(_REC)} AS recall, "
    f"{r4(f'2 * {_PREC} * {_REC} / greatest({_PREC} + {_REC}, 0.001)')} AS f1, "
    f"{r4('(tp + tn) / greatest(tp + fp + fn + tn, 1)')} AS accuracy"
)
_SWEEP = f"""sweep AS (
  SELECT threshold, tp, fp, fn, tn, {_RATES} FROM (
    SELECT round_even((0.1 + i * 0.05) * 100, 0)::DOUBLE / 100 AS threshold,
           count(*) FILTER (WHERE p >= t AND label = 1) AS tp, count(*) FILTER (WHERE p >= t AND label = 0) AS fp,
           count(*) FILTER (WHERE p < t AND label = 1) AS fn, count(*) FILTER (WHERE p < t AND label = 0) AS tn
    FROM scores, (SELECT i, 0.1::DOUBLE + i * ((0.9::DOUBLE - 0.1::DOUBLE) / 16) AS t FROM range(17) AS steps(i))
    GROUP BY i))"""


def _class_row(name: str, right: str, wrong: str, missed: str) -> str:
    return (
        f"SELECT '{name}' AS class, {right} / greatest({right} + {wrong}, 1) AS p, "
        f"{right} / greatest({right} + {missed}, 1) AS r, {right} + {missed} AS support FROM confused"
    )


_REPORT = f"""per_class AS (
  SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f
  FROM ({_class_row("Not Successful", "tn", "fn", "fp")} UNION ALL {_class_row("Successful", "tp", "fp", "fn")})),
report AS (
  SELECT class, p, r, f, support FROM per_class
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM per_class
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), sum(support)::BIGINT FROM per_class)"""

# The full model's features in order.
_FULL = (
    "total_events",
    "unique_event_types",
    "active_days",
    "active_weeks",
    "tenure_days",
    "events_per_day",
    "weekly_cadence",
    "event_diversity",
    "agent_events",
    "production_events",
    "collab_events",
    "credit_events",
    "agent_ratio",
    "production_ratio",
    "collab_ratio",
    "credit_ratio",
    "ever_published_app",
    "ever_scheduled",
    "ever_shared",
    "used_addon_credits",
    "fw_total_events",
    "fw_agent_events",
    "fw_production_events",
    "fw_canvas_events",
    "fw_unique_events",
    "fw_active_days",
)

_DISTANCES = [
    " + ".join(f"(z.{c} - s{i}.{c}) * (z.{c} - s{i}.{c})" for c in _CLUSTER) for i in range(4)
]
_LLOYD = f"""seeds AS (SELECT *, row_number() OVER (ORDER BY person_id) - 1 AS i FROM z ORDER BY person_id LIMIT 4),
distances AS (
  SELECT z.*, {", ".join(f"{d} AS d{i}" for i, d in enumerate(_DISTANCES))}
  FROM z, {", ".join(f"(SELECT * FROM seeds WHERE i = {i}) AS s{i}" for i in range(4))}),
placed AS (
  SELECT *, least(d0, d1, d2, d3) AS d,
         CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END AS cluster
  FROM distances)"""

SQL.update(
    {
        "feature_matrix": with_parts(
            "mart",
            f"""SELECT person_id, is_successful AS label, {", ".join(f"{r6(c)} AS {c}" for c in _FULL)},
                       {", ".join(f"evt_{n}::DOUBLE AS evt_{n}" for n in _EVENT_NAMES)}
                FROM mart JOIN matrix USING (person_id)""",
            f"matrix AS (SELECT person_id, {_MATRIX} FROM ev GROUP BY person_id)",
        ),
        "zscore_features": with_parts(
            "mart", "SELECT person_id, " + ", ".join(f"{r6(c)} AS {c}" for c in _CLUSTER) + " FROM z", _Z
        ),
        "stratified_split": with_parts(
            "mart",
            """SELECT person_id, label,
                      CASE WHEN rn <= greatest(1, floor(size * 0.2)) THEN 'test' ELSE 'train' END AS split FROM ranked""",
            _RANKED,
        ),
        "random_split": with_parts(
            "mart",
            """SELECT person_id, CASE WHEN rn_all <= floor(all_size * 0.2) THEN 'test' ELSE 'train' END AS split
               FROM ranked""",
            _RANKED,
        ),
        "stratified_sample": with_parts(
            "mart", "SELECT person_id, label AS is_successful FROM ranked WHERE rn <= 200", _RANKED
        ),
        "simple_sample": with_parts("mart", "SELECT person_id FROM ranked WHERE rn_all <= 300", _RANKED),
        "cv_folds": with_parts(
            "mart", "SELECT person_id, label, ((rn - 1) * 5 // size)::INT AS fold FROM ranked", _RANKED
        ),
        "lloyd_step": with_parts(
            "mart",
            f"""SELECT i::INT AS cluster, coalesce(users, 0) AS users, coalesce(inertia, 0::DOUBLE) AS inertia,
                       {", ".join(f"coalesce(m_{c}, {r6(c)}) AS {c}" for c in _CLUSTER)}
                FROM seeds LEFT JOIN (
                  SELECT cluster, count(*) AS users, {r6("sum(d)")} AS inertia,
                         {", ".join(f"{r6(f'avg({c})')} AS m_{c}" for c in _CLUSTER)}
                  FROM placed GROUP BY cluster) ON i = cluster""",
            _Z,
            _LLOYD,
        ),
        "best_stump": with_parts(
            "mart",
            f"""SELECT feature, threshold, polarity, errors, {r6("errors / n")} AS error FROM rules
                ORDER BY errors, feature_no, threshold, polarity DESC LIMIT 1""",
            _STUMP_PARTS,
        ),
        "best_stump_weighted": with_parts(
            "mart",
            f"""SELECT feature, threshold, polarity, errors::DOUBLE AS errors, {r6("errors::DOUBLE / n::DOUBLE")} AS error FROM rules
                ORDER BY rules.errors, feature_no, threshold, polarity DESC LIMIT 1""",
            _WEIGHTED_STUMP,
        ),
        "roc_points": with_parts(
            "mart",
            f"""SELECT {r6("t")} AS threshold, {r6("count(*) FILTER (WHERE label = 0 AND p >= t) / (SELECT count(*) FROM scores WHERE label = 0)")} AS fpr,
                       {r6("count(*) FILTER (WHERE label = 1 AND p >= t) / (SELECT count(*) FROM scores WHERE label = 1)")} AS tpr
                FROM scores, (SELECT DISTINCT p AS t FROM scores UNION ALL SELECT max(p) + 1 FROM scores) GROUP BY t""",
            _SCORED,
        ),
        "roc_auc": with_parts(
            "mart",
            f"""SELECT {r6("avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)")} AS auc
                FROM (SELECT p FROM scores WHERE label = 1) a, (SELECT p FROM scores WHERE label = 0) b""",
            _SCORED,
        ),
        "confusion": with_parts("mart", "SELECT tp, fp, fn, tn FROM confused", _SCORED),
        "precision_recall_f1": with_parts("mart", f"SELECT tp, fp, fn, tn, {_RATES} FROM confused", _SCORED),
        "threshold_sweep": with_parts("mart", "SELECT * FROM sweep", _SCORED, _SWEEP),
        "selected_thresholds": with_parts(
            "mart", "SELECT * FROM sweep WHERE threshold IN (0.2, 0.3, 0.4, 0.5, 0.6)", _SCORED, _SWEEP
        ),
        "classification_report": with_parts(
            "mart",
            f"""SELECT class, {r4("p")} AS precision, {r4("r")} AS recall, {r4("f")} AS f1, support FROM report""",
            _SCORED,
            _REPORT,
        ),
    }
)


def _centres(k: int, steps: int, tag: str = "") -> str:
    """Centres and nearest centres: ``c<tag>_<step>`` and ``n<tag>_<step>``."""
    distance = " + ".join(f"(z.{c} - s.{c}) * (z.{c} - s.{c})" for c in _CLUSTER)
    parts = [
        f"c{tag}_0 AS (SELECT *, row_number() OVER (ORDER BY person_id) - 1 AS cluster FROM z ORDER BY person_id LIMIT {k})"
    ]
    for step in range(steps + 1):
        parts.append(
            f"""n{tag}_{step} AS (
  SELECT person_id, cluster, d FROM (
    SELECT z.person_id, s.cluster, {distance} AS d, row_number() OVER (PARTITION BY z.person_id ORDER BY {distance}, s.cluster) AS rn
    FROM z, c{tag}_{step} AS s) WHERE rn = 1)"""
        )
        if step < steps:
            means = ", ".join(f"coalesce(m.{c}, o.{c}) AS {c}" for c in _CLUSTER)
            averages = ", ".join(f"avg(z.{c}) AS {c}" for c in _CLUSTER)
            parts.append(
                f"""c{tag}_{step + 1} AS (
  SELECT o.cluster, {means} FROM c{tag}_{step} o LEFT JOIN (
    SELECT n.cluster, {averages} FROM n{tag}_{step} n JOIN z USING (person_id) GROUP BY n.cluster) m ON o.cluster = m.cluster)"""
            )
    return ",\n".join(parts)


# Fixed values, as in the operators.
_PERSONAS = ("Power Users", "Casual Explorers", "Rising Stars", "One-time Visitors")
_RADAR = ("total_events", "active_days", "tenure_days", "retention_score", "depth_score", "success_score")
_NAMED = f"""named AS (
  SELECT cluster, CASE row_number() OVER (ORDER BY avg(success_score) DESC, cluster)
    {" ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_PERSONAS, 1))} END AS segment
  FROM mart JOIN n_2 USING (person_id) GROUP BY cluster),
seg AS (SELECT mart.*, cluster, segment FROM mart JOIN n_2 USING (person_id) JOIN named USING (cluster))"""


def _segmented(body: str) -> str:
    return with_parts("mart", body, _Z, _centres(4, 2), _NAMED)


def r2(expression: str) -> str:
    return f"round_even(({expression}) * 100, 0) / 100"


_PROFILE = ", ".join(f"{r2(f'avg({c})')} AS {c}" for c in (*_CLUSTER, "success_score"))
_THREE = """three AS (
  SELECT person_id, is_successful AS label, 'agent' AS model, d3_agent_events / (d3_total_events + 1) AS p FROM mart UNION ALL
  SELECT person_id, is_successful, 'production', d3_production_events / (d3_total_events + 1) FROM mart UNION ALL
  SELECT person_id, is_successful, 'days', d3_active_days / 4 FROM mart),
counts3 AS (
  SELECT model, count(*) FILTER (WHERE p > 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE p > 0.3 AND label = 0) AS fp,
         count(*) FILTER (WHERE p <= 0.3 AND label = 1) AS fn, count(*) FILTER (WHERE p <= 0.3 AND label = 0) AS tn
  FROM three GROUP BY model),
area3 AS (
  SELECT model, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
  FROM (SELECT * FROM three WHERE label = 1) a JOIN (SELECT * FROM three WHERE label = 0) b USING (model) GROUP BY model),
best3 AS (SELECT model FROM area3 ORDER BY round_even(auc * 1e4, 0) DESC, model LIMIT 1)"""
_FOLDS = """folded AS (SELECT p, scores.label, ((rn - 1) * 5 // size)::INT AS fold FROM scores JOIN ranked USING (person_id)),
fold_areas AS (
  SELECT fold, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
  FROM (SELECT * FROM folded WHERE label = 1) a JOIN (SELECT * FROM folded WHERE label = 0) b USING (fold) GROUP BY fold)"""
_RISK = """risk AS (
  SELECT person_id, p AS success_probability,
         CASE WHEN p < 0.3 THEN '🔴 High Risk' WHEN p < 0.6 THEN '🟡 Medium Risk' ELSE '🟢 Likely Success' END AS risk_flag FROM scores)"""

SQL.update(
    {
        "centre_segments": _segmented("SELECT person_id, cluster::INT AS cluster, segment FROM seg"),
        "centre_elbow": with_parts(
            "mart",
            unpivot(
                [
                    f"SELECT {k}::INT AS k, sum(round_even(d * 1e6::DOUBLE, 0)::BIGINT) / 1e6::DOUBLE AS inertia FROM n{k}_1"
                    for k in range(2, 9)
                ]
            ),
            _Z.replace("z AS", "unrounded AS", 1),
            "z AS (SELECT person_id, "
            + ", ".join(f"round_even({c} * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS {c}" for c in _CLUSTER)
            + " FROM unrounded)",
            *[_centres(k, 1, str(k)) for k in range(2, 9)],
        ),
        "centre_segment_success": _segmented(
            f"""SELECT segment, count(*) AS users, sum(is_successful)::BIGINT AS successful, {r6("avg(total_events)")} AS avg_events,
                       {r6("avg(tenure_days)")} AS avg_tenure, {pct("sum(is_successful)", "count(*)")} AS success_rate
                FROM seg GROUP BY segment"""
        ),
        "centre_segment_sizes": _segmented("SELECT segment, count(*) AS count FROM seg GROUP BY segment"),
        "centre_segment_profile": _segmented(f"SELECT segment, {_PROFILE} FROM seg GROUP BY segment"),
        "centre_cluster_profile": _segmented(f"SELECT cluster::INT AS cluster, {_PROFILE} FROM seg GROUP BY cluster"),
        "centre_segment_radar": _segmented(
            f"SELECT segment, {', '.join(f'{r6(f"avg({c})")} AS {c}' for c in _RADAR)} FROM seg GROUP BY segment"
        ),
        "centre_segment_upgrade": _segmented(
            f"""SELECT segment, count(*) AS users, {r1("avg(is_upgrade_candidate) * 100")} AS upgrade_rate,
                       {r1("avg(is_successful) * 100")} AS success_rate FROM seg GROUP BY segment"""
        ),
        "ratio_model_evaluation": with_parts(
            "mart", f"SELECT model, tp, fp, fn, tn, {_RATES}, {r4('auc')} AS auc FROM counts3 JOIN area3 USING (model)", _THREE
        ),
        "ratio_roc_curves": with_parts(
            "mart",
            f"""SELECT model, {r6("t")} AS threshold,
                       {r6("count(*) FILTER (WHERE label = 0 AND p >= t) / count(*) FILTER (WHERE label = 0)")} AS fpr,
                       {r6("count(*) FILTER (WHERE label = 1 AND p >= t) / count(*) FILTER (WHERE label = 1)")} AS tpr
                FROM three JOIN (SELECT DISTINCT model, p AS t FROM three UNION ALL SELECT model, max(p) + 1 FROM three GROUP BY model)
                USING (model) GROUP BY model, t""",
            _THREE,
        ),
        "ratio_best_report": with_parts(
            "mart",
            f"""SELECT class, {r4("p")} AS precision, {r4("r")} AS recall, {r4("f")} AS f1, support, model FROM report, best3""",
            _THREE,
            "confused AS (SELECT tp, fp, fn, tn FROM counts3 JOIN best3 USING (model))",
            _REPORT,
        ),
        "ratio_fold_auc": with_parts("mart", f"SELECT fold, {r6('auc')} AS auc FROM fold_areas", _SCORED, _RANKED, _FOLDS),
        "ratio_fold_interval": with_parts(
            "mart",
            f"""SELECT {r4("avg(auc)")} AS mean_auc, {r4("stddev_pop(auc)")} AS std_auc,
                       {r4("avg(auc) - 1.96 * stddev_pop(auc)")} AS ci_lo, {r4("avg(auc) + 1.96 * stddev_pop(auc)")} AS ci_hi
                FROM fold_areas""",
            _SCORED,
            _RANKED,
            _FOLDS,
        ),
        "ratio_risks": with_parts("mart", "SELECT * FROM risk", _SCORED, _RISK),
        "ratio_risk_distribution": with_parts(
            "mart", "SELECT risk_flag, count(*) AS users FROM risk GROUP BY risk_flag", _SCORED, _RISK
        ),
        "ratio_business_case": with_parts(
            "mart",
            f"""SELECT high_risk_users, {r6("recovery")} AS recovery_rate,
                       CAST(trunc(high_risk_users * recovery * 0.10::DOUBLE) AS BIGINT) AS estimated_recoveries,
                       u.candidates AS upgrade_candidates, u.pct AS upgrade_pct
                FROM (SELECT count(*) FILTER (WHERE risk_flag = '🔴 High Risk') AS high_risk_users FROM risk),
                     (SELECT (avg(success_rate) FILTER (WHERE milestones_hit >= 4)
                              - coalesce(max(success_rate) FILTER (WHERE milestones_hit = 0), 0.0::DOUBLE)) / 100 AS recovery
                      FROM ({SQL["success_by_milestones"]})), ({SQL["upgrade_candidates"]}) u""",
            _SCORED,
            _RISK,
        ),
    }
)
