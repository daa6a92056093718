"""SQL counterparts of the named queries, for another engine on the same benchmark tables.

Each text stands alone: it starts with the derived tables it needs as common table expressions.
"""

from __future__ import annotations

from hearthlog.sources.templates import MESSAGES

_NOW = "TIMESTAMP '2024-01-30 12:00:00'"
_ZONES = (
    "['UTC', 'Europe/Istanbul', 'America/New_York', 'Asia/Kathmandu', 'America/Sao_Paulo', 'Australia/Lord_Howe']"
)


def _zone(index: str) -> str:
    return f"{_ZONES}[CAST(({index}) % 6 AS INTEGER) + 1]"


def _local(instant: str, zone: str) -> str:
    return f"(({instant}) AT TIME ZONE 'UTC' AT TIME ZONE {zone})"


def _moved(instant: str, number: str, zone: str) -> str:
    """Local time when every fourth sensor is at +01:07."""
    return f"(CASE WHEN {number} % 4 = 1 THEN {instant} + INTERVAL 67 MINUTE ELSE {_local(instant, zone)} END)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _challenges(table: str, number: str) -> str:
    return f"""
SELECT n AS id, CASE WHEN n % 40 = 1 THEN n - 1 ELSE n END AS user_id,
       CASE WHEN n % 34 = 0 THEN ' ' ELSE sha256('code-' || n) END AS code_hash,
       base AS issued_at,
       base + to_minutes(CASE WHEN n % 38 = 0 THEN 0 ELSE 15 END) AS expires_at,
       base + to_minutes(CASE WHEN n % 46 = 0 THEN 21 ELSE 1 END) AS resend_available_at,
       CAST(n % 7 - CASE WHEN n % 58 = 0 THEN 7 ELSE 0 END AS INTEGER) AS failed_attempts,
       base + to_minutes(CASE WHEN n % 62 = 0 THEN 5 ELSE 0 END) AS created_at,
       base - to_minutes(CASE WHEN n % 74 = 0 THEN 5 ELSE 0 END) AS updated_at
FROM (SELECT {number} AS n, TIMESTAMP '2024-01-30 11:00:00' + to_minutes({number} % 90) AS base FROM {table})"""


_TABLES = {
    "users": f"""
SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email,
       CASE WHEN c_custkey % 2 = 0 THEN 'ENGLISH' ELSE 'TURKISH' END AS lang,
       CASE c_custkey % 3 WHEN 0 THEN 'CELSIUS' WHEN 1 THEN 'FAHRENHEIT' ELSE 'KELVIN' END AS tunit,
       {_zone('c_custkey')} AS tz, c_custkey % 5 <> 4 AS verified
FROM customer""",
    "ids": "SELECT DISTINCT user_id AS u FROM events",
    "sensors": f"""
SELECT u AS id, u % 10 AS owner_id,
       CASE u % 3 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' ELSE 'MOTION' END AS type,
       'sensor-' || u AS name, {_zone('u // 3')} AS tz, u % 7 <> 6 AS active
FROM ids""",
    "rules": """
SELECT 2 * u AS id, u % 10 AS owner_id, u AS sensor_id,
       CASE WHEN u % 3 = 2 THEN 'EVENT_DETECTED' ELSE 'NUMERIC_THRESHOLD' END AS rule_type,
       CASE WHEN u % 3 <> 2 THEN CASE WHEN u % 2 = 0 THEN 'ABOVE' ELSE 'BELOW' END END AS op,
       CASE u % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 40.0::DOUBLE END AS threshold,
       CASE u % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'PERCENT' END AS unit,
       CASE WHEN u % 3 = 2 THEN 'MOTION_DETECTED' END AS event_type,
       u % 11 <> 0 AS enabled, CAST(CASE WHEN u % 4 < 2 THEN 1440 ELSE 10080 END AS INTEGER) AS cooldown
FROM ids""",
    "requests": """
SELECT event_id AS id, ts, user_id AS u, event_type, value,
       (user_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) % 3 AS k,
       event_id % 89 <> 0 AS good_token,
       value - CASE WHEN event_id % 50 = 0 THEN 300.0::DOUBLE ELSE 20.0::DOUBLE END AS celsius,
       event_type IN ('click', 'error') AS motion
FROM events""",
    "classified": """
SELECT r.id, r.ts, r.k,
       CASE r.k WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' ELSE 'MOTION' END AS reported_type,
       CASE WHEN r.good_token AND bad.id IS NULL THEN r.u END AS sensor_id,
       CASE r.k WHEN 0 THEN celsius WHEN 1 THEN value END AS numeric_value,
       CASE WHEN r.k = 2 THEN motion END AS boolean_value,
       CASE WHEN bad.id IS NOT NULL THEN 'INVALID_REQUEST_400'
            WHEN NOT good_token THEN 'INVALID_TOKEN_401'
            WHEN r.u % 7 = 6 THEN 'INACTIVE_409'
            WHEN r.k <> r.u % 3 THEN 'TYPE_MISMATCH_400'
            ELSE 'ACCEPTED' END AS outcome
FROM requests r
LEFT JOIN (SELECT id FROM requests
           WHERE (k = 0 AND celsius < -273.15::DOUBLE) OR (k = 1 AND (value < 0 OR value > 100))) bad
  ON bad.id = r.id""",
    "readings": """
SELECT id, sensor_id, numeric_value, boolean_value,
       CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'PERCENT' END AS unit, ts AS recorded_at
FROM classified WHERE outcome = 'ACCEPTED'""",
    "local_readings": f"""
SELECT r.*, s.type, s.owner_id, s.tz, {_local('r.recorded_at', 's.tz')} AS local_at,
       CAST({_local(_NOW, 's.tz')} AS DATE) AS today
FROM readings r JOIN sensors s ON s.id = r.sensor_id""",
    "daily": f"""
SELECT s.id AS sensor_id, s.type AS sensor_type, s.owner_id, CAST(d.day AS DATE) AS local_date,
       CASE WHEN s.type = 'MOTION' THEN coalesce(a.detections, 0)::DOUBLE ELSE a.average END AS value
FROM (SELECT *, CAST({_local(_NOW, 'tz')} AS DATE) AS today FROM sensors) s,
     LATERAL (SELECT s.today - CAST(n AS INTEGER) AS day FROM range(7) t(n)) d
LEFT JOIN (SELECT sensor_id, CAST(local_at AS DATE) AS day, avg(numeric_value) AS average,
                  count(*) FILTER (WHERE boolean_value) AS detections
           FROM local_readings GROUP BY ALL) a
  ON a.sensor_id = s.id AND a.day = d.day""",
    "hourly": f"""
SELECT s.id AS sensor_id, s.type AS sensor_type, s.owner_id, s.today AS local_date, CAST(h.n AS SMALLINT) AS hour,
       CASE WHEN s.type = 'MOTION' THEN coalesce(a.detections, 0)::DOUBLE ELSE a.average END AS value
FROM (SELECT *, CAST({_local(_NOW, 'tz')} AS DATE) AS today FROM sensors) s
CROSS JOIN range(24) h(n)
LEFT JOIN (SELECT sensor_id, CAST(local_at AS DATE) AS day, hour(local_at) AS hour, avg(numeric_value) AS average,
                  count(*) FILTER (WHERE boolean_value) AS detections
           FROM local_readings GROUP BY ALL) a
  ON a.sensor_id = s.id AND a.day = s.today AND a.hour = h.n""",
    "matches": """
SELECT ru.id AS rule_id, r.id AS reading_id, r.sensor_id, r.recorded_at, r.numeric_value, ru.cooldown,
       row_number() OVER (PARTITION BY ru.id ORDER BY r.recorded_at, r.id) AS rn
FROM readings r JOIN rules ru ON ru.sensor_id = r.sensor_id JOIN users us ON us.id = ru.owner_id
WHERE ru.enabled AND us.verified
  AND CASE WHEN ru.rule_type = 'EVENT_DETECTED' THEN coalesce(r.boolean_value, false)
           WHEN ru.op = 'ABOVE' THEN r.unit = ru.unit AND r.numeric_value > ru.threshold
           ELSE r.unit = ru.unit AND r.numeric_value < ru.threshold END""",
    "walk": """
SELECT rule_id, rn, reading_id, sensor_id, recorded_at, numeric_value, cooldown, true AS fired, recorded_at AS last_fire
FROM matches WHERE rn = 1
UNION ALL
SELECT m.rule_id, m.rn, m.reading_id, m.sensor_id, m.recorded_at, m.numeric_value, m.cooldown,
       m.recorded_at >= w.last_fire + to_minutes(m.cooldown),
       CASE WHEN m.recorded_at >= w.last_fire + to_minutes(m.cooldown) THEN m.recorded_at ELSE w.last_fire END
FROM walk w JOIN matches m ON m.rule_id = w.rule_id AND m.rn = w.rn + 1""",
    "alerts": """
SELECT w.rule_id, w.reading_id, w.recorded_at, w.numeric_value, w.cooldown, ru.op, ru.threshold, ru.unit,
       s.id AS sensor_id, s.type, s.name, us.email, us.lang, us.tunit, us.tz
FROM walk w JOIN rules ru ON ru.id = w.rule_id JOIN sensors s ON s.id = w.sensor_id
JOIN users us ON us.id = ru.owner_id
WHERE w.fired""",
    "raw_readings": """
SELECT event_id AS id, user_id AS sensor_id,
       CASE WHEN event_id % 43 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 47 = 0 THEN 'Infinity'::DOUBLE
            WHEN user_id % 3 = 0 THEN value - CASE WHEN event_id % 50 = 0 THEN 300.0::DOUBLE ELSE 20.0::DOUBLE END
            WHEN user_id % 3 = 1 THEN value END AS numeric_value,
       CASE WHEN user_id % 3 = 2 OR event_id % 41 = 0 THEN event_type IN ('click', 'error') END AS boolean_value,
       CASE WHEN event_id % 37 = 0 THEN 'F' WHEN event_id % 31 = 0 THEN NULL
            WHEN user_id % 3 = 0 THEN 'C' WHEN user_id % 3 = 1 THEN 'PERCENT' END AS unit
FROM events""",
    "raw_rules": """
SELECT o_orderkey AS id, o_orderkey % 12 AS owner_id, o_custkey AS sensor_id,
       CASE WHEN o_orderkey % 23 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'P' THEN 'EVENT_DETECTED'
            ELSE 'NUMERIC_THRESHOLD' END AS rule_type,
       CASE WHEN o_orderkey % 19 = 0 THEN 'EQUAL' WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN NULL
            WHEN o_orderkey % 2 = 0 THEN 'ABOVE' ELSE 'BELOW' END AS op,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 29 = 0 THEN 'NaN'::DOUBLE
            ELSE o_totalprice / 500.0::DOUBLE - 300.0::DOUBLE END AS threshold,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 17 = 0 THEN 'K'
            WHEN o_custkey % 3 = 0 THEN 'C' ELSE 'PERCENT' END AS unit,
       CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 13 = 0 THEN 'DOOR_OPENED'
            ELSE 'MOTION_DETECTED' END END AS event_type,
       o_orderkey % 10500 AS cooldown
FROM orders""",
    "raw_sensors": f"""
SELECT p_partkey AS id, p_partkey % 160 AS owner_id,
       CASE WHEN p_partkey % 31 = 0 THEN 'PRESSURE' WHEN p_partkey % 3 = 0 THEN 'TEMPERATURE'
            WHEN p_partkey % 3 = 1 THEN 'HUMIDITY' ELSE 'MOTION' END AS type,
       CASE WHEN p_partkey % 29 = 0 THEN '  ' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name,
       CASE WHEN p_partkey % 37 = 0 THEN repeat('x', 101) ELSE 'Izmir' END AS city,
       CASE WHEN p_partkey % 41 = 0 THEN '' ELSE 'Konak' END AS district,
       CASE WHEN p_partkey % 43 = 0 THEN ' ' ELSE 'Kitchen' END AS home_location,
       CASE WHEN p_partkey % 47 = 0 THEN 'Mars/Olympus' WHEN p_partkey % 53 = 0 THEN ''
            ELSE {_zone('p_partkey')} END AS tz,
       CASE WHEN p_partkey % 17 = 0 THEN NULL
            ELSE sha256('part-' || (p_partkey - p_partkey % 50 % 2)) END AS token_hash
FROM part""",
    "raw_users": f"""
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 53 = 0 THEN '   '
            WHEN c_custkey % 14 = 0 THEN upper(c_mktsegment) || c_nationkey || '@EXAMPLE.COM'
            ELSE lower(c_name) || '@example.com' END AS email,
       CASE WHEN c_custkey % 59 = 0 THEN 'GERMAN' WHEN c_custkey % 2 = 0 THEN 'ENGLISH' ELSE 'TURKISH' END AS lang,
       CASE WHEN c_custkey % 61 = 0 THEN 'RANKINE' ELSE 'CELSIUS' END AS tunit,
       CASE WHEN c_custkey % 73 = 0 THEN '' ELSE {_zone('c_custkey')} END AS tz,
       TIMESTAMP '2023-12-01' AS created_at,
       CASE WHEN c_custkey % 67 = 0 THEN TIMESTAMP '2023-11-30'
            WHEN c_custkey % 5 <> 4 THEN TIMESTAMP '2023-12-02' END AS verified_at
FROM customer""",
    "challenges": _challenges("customer", "c_custkey"),
    "resets": _challenges("part", "p_partkey"),
    "code_requests": """
SELECT event_id AS id, ts AS requested_at, 'user-' || user_id AS address_key,
       CASE WHEN user_id % 10 = 3 THEN '[unknown]' ELSE 'client-' || (user_id % 10) END AS client_key
FROM events""",
}

# Which derived tables each derived table reads.
_NEEDS = {
    "sensors": ("ids",),
    "rules": ("ids",),
    "classified": ("requests",),
    "readings": ("classified",),
    "local_readings": ("readings", "sensors"),
    "daily": ("sensors", "local_readings"),
    "hourly": ("sensors", "local_readings"),
    "matches": ("readings", "rules", "users"),
    "walk": ("matches",),
    "alerts": ("walk", "rules", "sensors", "users"),
}


def _ordered(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        _ordered(_NEEDS.get(name, ()), done)
        if name not in done:
            done.append(name)
    return done


def _with(names: str, select: str, extra: dict[str, str] | None = None) -> str:
    parts = [f"{name} AS ({_TABLES[name]}\n)" for name in _ordered(tuple(names.split()), [])]
    parts += [f"{name} AS ({text}\n)" for name, text in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{select}" if parts else select


def _from_celsius(value: str, unit: str) -> str:
    return (
        f"CASE {unit} WHEN 'FAHRENHEIT' THEN ({value}) * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE "
        f"WHEN 'KELVIN' THEN ({value}) + 273.15::DOUBLE ELSE ({value}) END"
    )


def _shown(kind: str, value: str, unit: str) -> str:
    return f"CASE WHEN {kind} = 'TEMPERATURE' THEN {_from_celsius(value, unit)} ELSE {value} END"


def _temperature_symbol(unit: str) -> str:
    return f"CASE {unit} WHEN 'FAHRENHEIT' THEN '°F' WHEN 'KELVIN' THEN 'K' ELSE '°C' END"


def _symbol(kind: str, unit: str) -> str:
    return f"CASE {kind} WHEN 'TEMPERATURE' THEN {_temperature_symbol(unit)} WHEN 'HUMIDITY' THEN '% RH' ELSE '' END"


def _swap(text: str, lang: str) -> str:
    return (
        f"CASE WHEN {lang} = 'TURKISH' THEN replace(replace(replace({text}, ',', '#'), '.', ','), '#', '.') "
        f"ELSE {text} END"
    )


def _fixed_two(value: str) -> str:
    tie = f"(abs({value}) * 8.0::DOUBLE) % 4.0::DOUBLE = 1.0::DOUBLE"
    return f"printf('%.2f', CASE WHEN {tie} THEN {value} + sign({value}) * 0.001::DOUBLE ELSE {value} END)"


def _offset(instant: str, zone: str, zero: str) -> str:
    seconds = f"CAST(epoch({_local(instant, zone)}) - epoch({instant}) AS BIGINT)"
    return (
        f"CASE WHEN {seconds} = 0 THEN '{zero}' ELSE CASE WHEN {seconds} < 0 THEN '-' ELSE '+' END || "
        f"lpad(CAST(abs({seconds}) // 3600 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(abs({seconds}) % 3600 // 60 AS VARCHAR), 2, '0') END"
    )


def _date_label(day: str, lang: str) -> str:
    english = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"
    turkish = "['Pazar', 'Pazartesi', 'Salı', 'Çarşamba', 'Perşembe', 'Cuma', 'Cumartesi']"
    names = f"(CASE WHEN {lang} = 'TURKISH' THEN {turkish} ELSE {english} END)"
    return f"{names}[dayofweek({day}) + 1] || ', ' || strftime({day}, '%d-%m-%Y')"


def _metric(kind: str, value: str, lang: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN CASE WHEN {lang} = 'TURKISH' THEN 'Kayıtlı veri yok' "
        f"ELSE 'No data recorded' END WHEN {kind} = 'MOTION' THEN CAST(CAST(floor({value} + 0.5) AS BIGINT) AS VARCHAR) "
        f"ELSE {_fixed_two(value)} END"
    )


def _tooltip(kind: str, value: str, symbol: str, lang: str) -> str:
    label = (
        f"CASE WHEN {kind} = 'MOTION' THEN CASE WHEN {lang} = 'TURKISH' THEN 'Algılama sayısı: ' ELSE 'Detections: ' END "
        f"ELSE CASE WHEN {lang} = 'TURKISH' THEN 'Ortalama: ' ELSE 'Average: ' END END"
    )
    unit = f"CASE WHEN {kind} = 'MOTION' OR {symbol} = '' THEN '' ELSE ' ' || {symbol} END"
    return f"CASE WHEN {value} IS NULL THEN {_metric(kind, value, lang)} ELSE {label} || {_metric(kind, value, lang)} || {unit} END"


_FINITE = "NOT isnan({0}) AND NOT isinf({0})"


def _checks(table: str, source: str, checks: dict[str, str]) -> str:
    """One row per check that is false; a NULL check is kept."""
    listed = ", ".join(
        f"CASE WHEN NOT coalesce({kept}, true) THEN '{rule}' END" for rule, kept in checks.items()
    )
    return (
        f"SELECT '{table}' AS table_name, rule, row_id FROM "
        f"(SELECT id AS row_id, unnest([{listed}]) AS rule FROM {source}) WHERE rule IS NOT NULL"
    )


def _range_checks(prefix: str, unit: str, value: str) -> dict[str, str]:
    return {
        f"{prefix}temperature_range": f"{unit} IS DISTINCT FROM 'C' OR {value} >= -273.15::DOUBLE",
        f"{prefix}humidity_range": f"{unit} IS DISTINCT FROM 'PERCENT' OR {value} BETWEEN 0.0::DOUBLE AND 100.0::DOUBLE",
    }


def _quality() -> str:
    readings = {
        "value_shape": "(numeric_value IS NOT NULL AND boolean_value IS NULL AND unit IS NOT NULL) OR "
        "(numeric_value IS NULL AND boolean_value IS NOT NULL AND unit IS NULL)",
        "unit_known": "unit IS NULL OR unit IN ('C', 'PERCENT')",
        "numeric_finite": f"numeric_value IS NULL OR ({_FINITE.format('numeric_value')})",
        **_range_checks("", "unit", "numeric_value"),
    }
    rules = {
        "rule_type_known": "rule_type IN ('NUMERIC_THRESHOLD', 'EVENT_DETECTED')",
        "operator_known": "op IS NULL OR op IN ('ABOVE', 'BELOW')",
        "event_known": "event_type IS NULL OR event_type IN ('MOTION_DETECTED')",
        "rule_shape": "(rule_type = 'NUMERIC_THRESHOLD' AND op IS NOT NULL AND threshold IS NOT NULL "
        "AND unit IS NOT NULL AND trim(unit) <> '' AND event_type IS NULL) OR (rule_type = 'EVENT_DETECTED' "
        "AND event_type IS NOT NULL AND op IS NULL AND threshold IS NULL AND unit IS NULL)",
        "cooldown_range": "cooldown BETWEEN 1 AND 10080",
        "threshold_unit_known": "unit IS NULL OR unit IN ('C', 'PERCENT')",
        "threshold_finite": f"threshold IS NULL OR ({_FINITE.format('threshold')})",
        **_range_checks("threshold_", "unit", "threshold"),
    }
    pairs = {
        "numeric_rule_needs_numeric_sensor": "rule_type <> 'NUMERIC_THRESHOLD' OR type <> 'MOTION'",
        "unit_matches_sensor": "rule_type <> 'NUMERIC_THRESHOLD' OR unit IS NOT DISTINCT FROM "
        "CASE type WHEN 'TEMPERATURE' THEN 'C' WHEN 'HUMIDITY' THEN 'PERCENT' END",
        "event_rule_needs_motion_sensor": "rule_type <> 'EVENT_DETECTED' OR type = 'MOTION'",
        "owner_matches_sensor": "owner_id = sensor_owner",
    }
    sensors = {
        "type_known": "type IN ('TEMPERATURE', 'HUMIDITY', 'MOTION')",
        **{
            f"{public}_not_blank": f"trim({column}) <> ''"
            for public, column in (
                ("name", "name"), ("city", "city"), ("district", "district"),
                ("home_location", "home_location"), ("time_zone_id", "tz"),
            )
        },
        **{
            f"{public}_length": f"length({column}) <= {limit}"
            for public, column, limit in (
                ("type", "type", 40), ("name", "name", 100), ("city", "city", 100), ("district", "district", 100),
                ("home_location", "home_location", 100), ("time_zone_id", "tz", 64),
                ("ingestion_token_hash", "token_hash", 64),
            )
        },
    }
    users = {
        "email_not_blank": "trim(email) <> ''",
        "timezone_not_blank": "trim(tz) <> ''",
        "language_known": "lang IN ('ENGLISH', 'TURKISH')",
        "temperature_unit_known": "tunit IN ('CELSIUS', 'FAHRENHEIT', 'KELVIN')",
        "verified_after_creation": "verified_at IS NULL OR verified_at >= created_at",
        "email_length": "length(email) <= 320",
    }
    challenges = {
        "code_not_blank": "trim(code_hash) <> ''",
        "attempts_not_negative": "failed_attempts >= 0",
        "issued_after_creation": "issued_at >= created_at",
        "expires_after_issue": "expires_at > issued_at",
        "resend_window": "resend_available_at >= issued_at AND resend_available_at < expires_at",
        "updated_after_creation": "updated_at >= created_at",
    }
    joined = (
        "(SELECT r.*, s.type, s.owner_id AS sensor_owner FROM raw_rules r JOIN sensors s ON s.id = r.sensor_id)"
    )
    return _with(
        "raw_readings raw_rules raw_sensors raw_users challenges resets sensors",
        "\nUNION ALL\n".join(
            [
                _checks("sensor_readings", "raw_readings", readings),
                _checks("alert_rules", "raw_rules", rules),
                _checks("alert_rules", joined, pairs),
                _checks("sensors", "raw_sensors", sensors),
                _checks("app_users", "raw_users", users),
                _checks("email_verification_challenges", "challenges", challenges),
                _checks("password_reset_challenges", "resets", challenges),
            ]
        ),
    )


def _cap(name: str, key: str, limit: int) -> dict[str, str]:
    """Recursive walk of one cap: anchor and admitted count per key, windows of one day."""
    return {
        f"{name}_rows": f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY requested_at, id) AS rn FROM code_requests""",
        f"{name}_walk": f"""
SELECT id, {key} AS k, rn, true AS allowed, requested_at AS anchor, 1 AS used FROM {name}_rows WHERE rn = 1
UNION ALL
SELECT r.id, r.{key}, r.rn, r.requested_at >= w.anchor + INTERVAL 1 DAY OR w.used < {limit},
       CASE WHEN r.requested_at >= w.anchor + INTERVAL 1 DAY THEN r.requested_at ELSE w.anchor END,
       CASE WHEN r.requested_at >= w.anchor + INTERVAL 1 DAY THEN 1
            WHEN w.used < {limit} THEN w.used + 1 ELSE w.used END
FROM {name}_walk w JOIN {name}_rows r ON r.{key} = w.k AND r.rn = w.rn + 1""",
    }


def _messages() -> str:
    rows = ", ".join(
        f"({_quoted(lang)}, {_quoted(key)}, {_quoted(text)})"
        for lang, bundle in MESSAGES.items()
        for key, text in bundle.items()
    )
    number = lambda value: _swap(
        f"regexp_replace(format('{{:,.2f}}', {value}), '(\\.[0-9])0$', '\\1')", "a.lang"
    )
    minutes = _swap("format('{:,d}', a.cooldown)", "a.lang")
    when = (
        f"strftime({_local('a.recorded_at', 'a.tz')}, '%d-%m-%Y %H:%M:%S') || ' ' || {_offset('a.recorded_at', 'a.tz', 'Z')}"
    )
    reading = f"CASE WHEN a.unit = 'C' THEN {_from_celsius('a.numeric_value', 'a.tunit')} ELSE a.numeric_value END"
    threshold = f"CASE WHEN a.unit = 'C' THEN {_from_celsius('a.threshold', 'a.tunit')} ELSE a.threshold END"
    symbol = f"CASE WHEN a.unit = 'C' THEN {_temperature_symbol('a.tunit')} ELSE '% RH' END"
    place = ["a.name", "'Living room'", "'Izmir'", "'Konak'"]

    def filled(template: str, values: list[str]) -> str:
        for index, value in enumerate(values):
            template = f"replace({template}, '{{{index}}}', {value})"
        return template

    numeric = filled("b.template", [*place, "c.template", number(reading), number(threshold), symbol, when, minutes])
    motion = filled("b.template", [*place, "e.template", when, minutes])
    return _with(
        "alerts",
        f"""
SELECT a.rule_id, a.reading_id, a.email, replace(s.template, '{{0}}', a.name) AS subject,
       CASE WHEN a.type = 'MOTION' THEN {motion} ELSE {numeric} END AS body
FROM alerts a
JOIN texts s ON s.lang = a.lang AND s.key = 'email.alert.' || lower(a.type) || '.subject'
JOIN texts b ON b.lang = a.lang AND b.key = 'email.alert.' || lower(a.type) || '.body'
JOIN texts e ON e.lang = a.lang AND e.key = 'alertEventType.MOTION_DETECTED'
LEFT JOIN texts c ON c.lang = a.lang AND c.key = 'comparisonOperator.' || a.op""",
        {"texts": f"SELECT * FROM (VALUES {rows}) t(lang, key, template)"},
    )


_NESTED_POINTS = f"""
SELECT d.sensor_id, d.sensor_type, 'weekly' AS series, CAST(d.local_date AS VARCHAR) AS bucket,
       d.local_date AS day, CAST(NULL AS SMALLINT) AS hour, {_shown('d.sensor_type', 'd.value', 'u.tunit')} AS value, u.tunit
FROM daily d LEFT JOIN users u ON u.id = d.owner_id
UNION ALL
SELECT h.sensor_id, h.sensor_type, 'hourly', CAST(h.hour AS VARCHAR), h.local_date, h.hour,
       {_shown('h.sensor_type', 'h.value', 'u.tunit')}, u.tunit
FROM hourly h LEFT JOIN users u ON u.id = h.owner_id"""

_HAS_DATA = """
SELECT sensor_id,
       bool_or(series = 'weekly' AND (sensor_type = 'MOTION' OR value IS NOT NULL)) AS weekly_has_data,
       bool_or(series = 'hourly' AND (sensor_type = 'MOTION' OR value IS NOT NULL)) AS hourly_has_data,
       max(day) AS today
FROM points GROUP BY sensor_id"""


def all_oracles() -> dict[str, str]:
    ingest_rows = _with(
        "readings",
        "SELECT id, sensor_id, numeric_value, boolean_value, unit, recorded_at FROM readings",
    )
    fired = _with(
        "walk", "SELECT rule_id, reading_id, sensor_id, recorded_at, numeric_value FROM walk WHERE fired"
    )
    rollup = _with(
        "readings",
        """
SELECT sensor_id, unit, time_bucket(INTERVAL 15 MINUTE, recorded_at) AS slot_start,
       round(sum(numeric_value), 6) AS sum_value, count(numeric_value) AS n_values,
       count(*) FILTER (WHERE boolean_value) AS n_detections
FROM readings WHERE numeric_value IS NOT NULL OR boolean_value GROUP BY ALL""",
    )
    kept_sensors = "SELECT id FROM sensors WHERE active"
    labels_value = _shown("d.sensor_type", "round(d.value, 6)", "u.tunit")
    texts = {
        "daily_stats_7d": _with(
            "daily", "SELECT sensor_id, sensor_type, local_date, round(value, 6) AS value FROM daily"
        ),
        "hourly_stats": _with(
            "hourly", "SELECT sensor_id, sensor_type, local_date, hour, round(value, 6) AS value FROM hourly"
        ),
        "hourly_json": _with(
            "hourly users",
            f"""
SELECT sensor_id, local_date,
       CAST(to_json(list(struct_pack(hour := hour, value := round(shown, 6)) ORDER BY hour)) AS VARCHAR) AS series_json
FROM (SELECT h.sensor_id, h.local_date, h.hour, {_shown('h.sensor_type', 'h.value', 'u.tunit')} AS shown
      FROM hourly h LEFT JOIN users u ON u.id = h.owner_id)
GROUP BY sensor_id, local_date""",
        ),
        "sensor_statistics_nested": _with(
            "daily hourly users",
            f"""
SELECT p.sensor_id, p.sensor_type, {_symbol('p.sensor_type', 'p.tunit')} AS unit_symbol, h.today,
       true AS shape_ok, h.weekly_has_data, h.hourly_has_data, p.bucket, round(p.value, 6) AS value
FROM points p JOIN shown h USING (sensor_id)""",
            {"points": _NESTED_POINTS, "shown": _HAS_DATA},
        ),
        "rollup_15m": rollup,
        "local_day_bounds": _with(
            "sensors",
            f"""
SELECT id AS sensor_id, day AS local_date,
       CAST(day AS TIMESTAMP) AT TIME ZONE tz AT TIME ZONE 'UTC' AS starts_at,
       CAST(day + 1 AS TIMESTAMP) AT TIME ZONE tz AT TIME ZONE 'UTC' AS ends_at
FROM (SELECT id, tz, CAST({_local(_NOW, 'tz')} AS DATE) - CAST(n AS INTEGER) AS day FROM sensors, range(7) t(n))""",
        ),
        "allowed_series_dates": _with(
            "local_readings",
            "SELECT DISTINCT sensor_id, CAST(recorded_at AS DATE) AS date FROM local_readings "
            "WHERE CAST(recorded_at AS DATE) <= today",
        ),
        "recent_readings": _with(
            "local_readings users",
            f"""
SELECT sensor_id, owner_id, position, reading_id, type AS sensor_type, 'Living room' AS location,
       round(shown, 6) AS numeric_value, boolean_value, {_symbol('type', 'tunit')} AS unit_symbol,
       CASE WHEN type = 'MOTION' THEN CASE WHEN lang = 'TURKISH' THEN CASE WHEN boolean_value THEN 'Algılandı'
            ELSE 'Hareket yok' END ELSE CASE WHEN boolean_value THEN 'Detected' ELSE 'No motion' END END
            ELSE {_swap("printf('%.2f', shown)", 'lang')} || ' ' || {_symbol('type', 'tunit')} END AS value_text,
       strftime(local_at, '%d-%m-%Y %H:%M:%S') AS local_time,
       {_offset('recorded_at', 'tz', 'Z')} || '[' || tz || ']' AS offset_text
FROM (SELECT r.sensor_id, r.owner_id, r.id AS reading_id, r.type, r.boolean_value, r.local_at, r.recorded_at, r.tz,
             u.tunit, u.lang, {_shown('r.type', 'r.numeric_value', 'u.tunit')} AS shown,
             CAST(row_number() OVER (PARTITION BY r.sensor_id ORDER BY r.recorded_at DESC, r.id DESC) AS INTEGER)
               AS position
      FROM local_readings r LEFT JOIN users u ON u.id = r.owner_id)
WHERE position <= 10""",
        ),
        "sensor_list": _with(
            "sensors",
            "SELECT owner_id, id, name, type, 'Izmir' AS city, 'Konak' AS district, "
            "'Living room' AS home_location, tz AS timezone, active FROM sensors",
        ),
        "rule_list": _with(
            "rules sensors users",
            f"""
SELECT r.owner_id, r.id, r.sensor_id, s.name AS sensor_name, 'Living room' AS sensor_home_location,
       s.type AS sensor_type, r.rule_type, r.op AS comparison_operator, r.event_type,
       round({_shown('s.type', 'r.threshold', 'u.tunit')}, 6) AS threshold_value,
       r.cooldown AS cooldown_minutes, r.enabled, TIMESTAMP '2023-12-15' AS created_at
FROM rules r JOIN sensors s ON s.id = r.sensor_id JOIN users u ON u.id = r.owner_id""",
        ),
        "owner_counts": _with(
            "sensors rules readings",
            """
SELECT s.owner_id, count(*) AS n_sensors, CAST(sum(coalesce(c.shown, 0)) AS BIGINT) AS n_recent_readings,
       any_value(coalesce(r.n, 0)) AS n_rules
FROM sensors s
LEFT JOIN (SELECT sensor_id, least(count(*), 10) AS shown FROM readings GROUP BY sensor_id) c ON c.sensor_id = s.id
LEFT JOIN (SELECT owner_id, count(*) AS n FROM rules GROUP BY owner_id) r ON r.owner_id = s.owner_id
GROUP BY s.owner_id""",
        ),
        "readings_in_range": _with(
            "readings",
            "SELECT * FROM readings WHERE recorded_at >= TIMESTAMP '2024-01-22' "
            "AND recorded_at < TIMESTAMP '2024-01-29' AND (unit IN ('C', 'PERCENT') OR boolean_value)",
        ),
        "stored_readings": _with(
            "readings",
            "SELECT *, CAST(recorded_at AS DATE) AS recorded_date FROM readings "
            "WHERE recorded_at >= TIMESTAMP '2024-01-22' AND recorded_at < TIMESTAMP '2024-01-29'",
        ),
        "unusable_zones": _with(
            "raw_sensors",
            f"SELECT id AS sensor_id, tz AS time_zone_id FROM raw_sensors WHERE NOT list_contains({_ZONES}, tz)",
        ),
        "rule_form_sensors": _with(
            "sensors",
            "SELECT id AS sensor_id, type <> 'MOTION' AS numeric_rules, type = 'MOTION' AS motion_rules, "
            "CASE type WHEN 'TEMPERATURE' THEN 'C' WHEN 'HUMIDITY' THEN 'PERCENT' END AS unit FROM sensors",
        ),
        "unit_conversions": _with(
            "readings",
            f"""
SELECT id AS reading_id, round(numeric_value, 6) AS celsius,
       round({_from_celsius('numeric_value', "'FAHRENHEIT'")}, 6) AS fahrenheit,
       round({_from_celsius('numeric_value', "'KELVIN'")}, 6) AS kelvin,
       round((numeric_value - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE, 6) AS read_as_fahrenheit,
       round(numeric_value - 273.15::DOUBLE, 6) AS read_as_kelvin
FROM readings WHERE unit = 'C'""",
        ),
        "ingest_outcomes": _with(
            "classified", "SELECT outcome, count(*) AS requests FROM classified GROUP BY outcome"
        ),
        "accepted_readings": ingest_rows,
        "rejects": _with(
            "classified",
            "SELECT id AS request_id, ts AS received_at, reported_type, sensor_id, outcome "
            "FROM classified WHERE outcome <> 'ACCEPTED'",
        ),
        "last_seen": _with(
            "sensors readings",
            "SELECT s.id AS sensor_id, max(r.recorded_at) AS last_seen_at "
            "FROM sensors s LEFT JOIN readings r ON r.sensor_id = s.id GROUP BY s.id",
        ),
        "valid_measurements": _with(
            "raw_readings sensors",
            f"""
SELECT r.id AS reading_id, r.sensor_id,
       coalesce({_FINITE.format('numeric_value')} AND
         CASE s.type WHEN 'TEMPERATURE' THEN numeric_value >= -273.15::DOUBLE
                     WHEN 'HUMIDITY' THEN numeric_value BETWEEN 0.0::DOUBLE AND 100.0::DOUBLE ELSE false END,
         false) AS valid
FROM raw_readings r JOIN sensors s ON s.id = r.sensor_id""",
        ),
        "normalized_emails": _with(
            "raw_users", "SELECT id AS user_id, nullif(lower(trim(email)), '') AS email FROM raw_users"
        ),
        "active_rules": _with(
            "rules users",
            "SELECT r.id AS rule_id, r.owner_id, r.sensor_id FROM rules r JOIN users u ON u.id = r.owner_id "
            "WHERE r.enabled AND u.verified",
        ),
        "alert_matches": _with(
            "matches",
            "SELECT rule_id, reading_id, sensor_id, recorded_at, numeric_value, cooldown AS cooldown_minutes "
            "FROM matches",
        ),
        "alerts_fired": fired,
        "alerts_suppressed": _with(
            "walk", "SELECT rule_id, count(*) AS n_suppressed FROM walk WHERE NOT fired GROUP BY rule_id"
        ),
        "alert_events": _with(
            "alerts",
            """
SELECT rule_id, reading_id, email AS recipient_email, lang AS recipient_language, tunit AS recipient_temperature_unit,
       tz AS recipient_timezone, sensor_id, type AS sensor_type, name AS sensor_name,
       'Living room' AS sensor_home_location, 'Izmir' AS sensor_city, 'Konak' AS sensor_district, recorded_at,
       cooldown AS cooldown_minutes, op AS comparison_operator, numeric_value AS reading_value,
       threshold AS threshold_value, unit
FROM alerts""",
        ),
        "rule_cooldowns": _with(
            "walk rules",
            f"""
SELECT r.id AS rule_id, f.last_fired_at,
       coalesce(f.last_fired_at + to_minutes(r.cooldown) > {_NOW}, false) AS cooling_down
FROM rules r
LEFT JOIN (SELECT rule_id, max(recorded_at) AS last_fired_at FROM walk WHERE fired GROUP BY rule_id) f
  ON f.rule_id = r.id""",
        ),
        "alert_messages": _messages(),
        "cap_per_window": _with(
            "code_requests",
            "SELECT c.id, c.client_key, c.requested_at, w.allowed FROM code_requests c JOIN client_walk w USING (id)",
            _cap("client", "client_key", 20),
        ),
        "cap_two_keys": _with(
            "code_requests",
            """
SELECT c.id, c.address_key, c.client_key, a.allowed AS address_allowed, w.allowed AS client_allowed,
       a.allowed AND w.allowed AS allowed
FROM code_requests c JOIN address_walk a USING (id) JOIN client_walk w USING (id)""",
            {**_cap("address", "address_key", 2), **_cap("client", "client_key", 20)},
        ),
        "quality_violations": _quality(),
        "duplicate_keys": _with(
            "raw_users raw_sensors challenges resets",
            """
SELECT 'app_users' AS table_name, 'email' AS rule, lower(email) AS key_value, count(*) AS n_rows
FROM raw_users GROUP BY lower(email) HAVING count(*) > 1
UNION ALL
SELECT 'sensors', 'owner_name', owner_id || '|' || lower(name), count(*)
FROM raw_sensors GROUP BY owner_id, lower(name) HAVING count(*) > 1
UNION ALL
SELECT 'sensors', 'token_hash', token_hash, count(*)
FROM raw_sensors WHERE token_hash IS NOT NULL GROUP BY token_hash HAVING count(*) > 1
UNION ALL
SELECT 'email_verification_challenges', 'user_id', CAST(user_id AS VARCHAR), count(*)
FROM challenges GROUP BY user_id HAVING count(*) > 1
UNION ALL
SELECT 'password_reset_challenges', 'user_id', CAST(user_id AS VARCHAR), count(*)
FROM resets GROUP BY user_id HAVING count(*) > 1""",
        ),
        "name_taken": _with(
            "raw_sensors",
            "SELECT id, owner_id, name FROM raw_sensors c WHERE EXISTS (SELECT 1 FROM raw_sensors h "
            "WHERE h.owner_id = c.owner_id AND lower(trim(h.name)) = lower(trim(c.name)) AND h.id <> c.id)",
        ),
        "orphans": _with(
            "raw_rules raw_sensors sensors users readings challenges resets",
            """
SELECT 'alert_rules' AS table_name, 'sensor_id' AS reference, id AS row_id, sensor_id AS missing_id
FROM raw_rules WHERE sensor_id NOT IN (SELECT id FROM sensors)
UNION ALL
SELECT 'alert_rules', 'owner_id', id, owner_id FROM raw_rules WHERE owner_id NOT IN (SELECT id FROM users)
UNION ALL
SELECT 'sensors', 'owner_id', id, owner_id FROM raw_sensors WHERE owner_id NOT IN (SELECT id FROM users)
UNION ALL
SELECT 'sensor_readings', 'sensor_id', id, sensor_id FROM readings
WHERE sensor_id NOT IN (SELECT id FROM raw_sensors)
UNION ALL
SELECT 'email_verification_challenges', 'user_id', id, user_id FROM challenges
WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL
SELECT 'password_reset_challenges', 'user_id', id, user_id FROM resets WHERE user_id NOT IN (SELECT id FROM users)""",
        ),
        "rule_owner_mismatch": _with(
            "raw_rules sensors",
            "SELECT r.id AS rule_id, r.sensor_id, r.owner_id, s.owner_id AS sensor_owner_id "
            "FROM raw_rules r JOIN sensors s ON s.id = r.sensor_id WHERE r.owner_id <> s.owner_id",
        ),
        "canonical_rules": _with(
            "sensors users",
            """
SELECT form_id, owner_id, sensor_id, rule_type,
       CASE WHEN status = 'OK' THEN op END AS comparison_operator,
       CASE WHEN status = 'OK' THEN round(canonical, 6) END AS threshold_value,
       CASE WHEN status = 'OK' THEN CASE type WHEN 'TEMPERATURE' THEN 'C' WHEN 'HUMIDITY' THEN 'PERCENT' END END
         AS threshold_unit,
       CASE WHEN status = 'OK' AND rule_type = 'EVENT_DETECTED' THEN 'MOTION_DETECTED' END AS event_type,
       cooldown AS cooldown_minutes, status
FROM (SELECT *, CASE
        WHEN cooldown IS NULL OR cooldown NOT BETWEEN 1 AND 10080
          OR (rule_type = 'NUMERIC_THRESHOLD' AND (op IS NULL OR threshold IS NULL)) THEN 'INVALID_FORM'
        WHEN sensor_owner IS DISTINCT FROM owner_id THEN 'SENSOR_NOT_OWNED'
        WHEN (rule_type = 'NUMERIC_THRESHOLD') = (type = 'MOTION') THEN 'WRONG_SENSOR_TYPE'
        WHEN rule_type = 'NUMERIC_THRESHOLD' AND type = 'TEMPERATURE' AND canonical < -273.15::DOUBLE
          THEN 'THRESHOLD_OUT_OF_RANGE'
        WHEN rule_type = 'NUMERIC_THRESHOLD' AND type = 'HUMIDITY' AND (canonical < 0 OR canonical > 100)
          THEN 'THRESHOLD_OUT_OF_RANGE'
        ELSE 'OK' END AS status
      FROM (SELECT f.*, s.type, s.owner_id AS sensor_owner,
              CASE WHEN s.type = 'TEMPERATURE' THEN CASE u.tunit
                     WHEN 'FAHRENHEIT' THEN (f.threshold - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE
                     WHEN 'KELVIN' THEN f.threshold - 273.15::DOUBLE ELSE f.threshold END
                   ELSE f.threshold END AS canonical
            FROM forms f LEFT JOIN sensors s ON s.id = f.sensor_id LEFT JOIN users u ON u.id = f.owner_id))""",
            {
                "forms": """
SELECT o_orderkey AS form_id, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 11 ELSE o_custkey % 10 END AS owner_id,
       o_custkey AS sensor_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'EVENT_DETECTED' ELSE 'NUMERIC_THRESHOLD' END AS rule_type,
       CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 21 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ABOVE'
            ELSE 'BELOW' END AS op,
       CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 25 = 0 THEN NULL
            ELSE o_totalprice / 1000.0::DOUBLE - 200.0::DOUBLE END AS threshold,
       CASE WHEN o_orderkey % 27 = 0 THEN NULL ELSE CAST(o_orderkey % 10500 AS INTEGER) END AS cooldown
FROM orders"""
            },
        ),
        "retained_readings": _with(
            "readings", "SELECT * FROM readings WHERE recorded_at >= TIMESTAMP '2024-01-16 12:00:00'"
        ),
        "retained_challenges": _with(
            "challenges resets",
            f"""
SELECT *, 'email_verification_challenges' AS table_name FROM challenges WHERE expires_at > {_NOW}
UNION ALL
SELECT *, 'password_reset_challenges' FROM resets WHERE expires_at > {_NOW}""",
        ),
        "after_sensor_delete": _with(
            "sensors raw_readings rules",
            f"""
SELECT 'sensors' AS table_name, id AS row_id FROM sensors WHERE active
UNION ALL SELECT 'sensor_readings', id FROM raw_readings WHERE sensor_id IN ({kept_sensors})
UNION ALL SELECT 'alert_rules', id FROM rules WHERE sensor_id IN ({kept_sensors})""",
        ),
        "metric_labels": _with(
            "daily users",
            f"""
SELECT sensor_id, local_date, {_date_label('local_date', 'lang')} AS label,
       {_metric('sensor_type', 'shown', 'lang')} AS value_text,
       {_tooltip('sensor_type', 'shown', 'symbol', 'lang')} AS tooltip
FROM (SELECT d.*, u.lang, {_symbol('d.sensor_type', 'u.tunit')} AS symbol, {labels_value} AS shown
      FROM daily d LEFT JOIN users u ON u.id = d.owner_id)""",
        ),
        "statistics_table": _with(
            "daily hourly users",
            f"""
SELECT p.sensor_id, p.series,
       CASE WHEN p.series = 'weekly' THEN strftime(p.day, '%Y-%m-%d') ELSE lpad(p.bucket, 2, '0') END AS position,
       CASE WHEN p.series = 'weekly' THEN {_date_label('p.day', "'ENGLISH'")}
            ELSE lpad(p.bucket, 2, '0') || ':00–' || lpad(CAST((p.hour + 1) % 24 AS VARCHAR), 2, '0') || ':00' END AS label,
       {_metric('p.sensor_type', 'p.value', "'ENGLISH'")} AS value_text,
       {_tooltip('p.sensor_type', 'p.value', _symbol('p.sensor_type', 'p.tunit'), "'ENGLISH'")} AS tooltip
FROM points p JOIN shown h USING (sensor_id)
WHERE CASE WHEN p.series = 'weekly' THEN h.weekly_has_data ELSE h.hourly_has_data END""",
            {
                "exact": _NESTED_POINTS,
                "points": "SELECT * REPLACE (round(value, 6) AS value) FROM exact",
                "shown": _HAS_DATA,
            },
        ),
        "zone_labels": _with(
            "users",
            f"SELECT DISTINCT tz AS zone, 'UTC' || {_offset(_NOW, 'tz', '+00:00')} || ' - ' || tz AS label FROM users",
        ),
        "calibrate_adc": """
SELECT order_id, line_id, adc, round(celsius, 6) AS celsius,
       NOT isnan(celsius) AND NOT isinf(celsius) AND celsius >= -273.15::DOUBLE AS valid
FROM (SELECT order_id, line_id, adc,
             CASE WHEN adc = 0 THEN -999.0::DOUBLE
                  ELSE 1.0::DOUBLE / (0.001129148::DOUBLE
                       + (0.000234125::DOUBLE + (0.0000000876741::DOUBLE * lr * lr)) * lr) - 273.15::DOUBLE END AS celsius
      FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_id, CAST(trunc(l_extendedprice) AS BIGINT) % 1024 AS adc,
                   ln(11000.0::DOUBLE * (1024.0::DOUBLE
                      / nullif(CAST(trunc(l_extendedprice) AS BIGINT) % 1024, 0)::DOUBLE - 1.0::DOUBLE)) AS lr
            FROM lineitem))""",
        "lenient_payloads": """
SELECT event_id AS id,
       CASE event_id % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true
            WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN false END AS motion,
       CASE event_id % 5 WHEN 0 THEN value WHEN 3 THEN value WHEN 4 THEN value END AS number
FROM events""",
        "stream_ingest": ingest_rows,
        "stream_compacted": ingest_rows,
        "rule_order": _with(
            "readings rules users",
            """
SELECT r.id AS reading_id, ru.id AS rule_id, CAST(row_number() OVER (PARTITION BY r.id ORDER BY ru.id) AS INTEGER) AS place
FROM readings r JOIN (
  SELECT id, owner_id, sensor_id, rule_type, op, threshold, unit, enabled FROM rules
  UNION ALL SELECT id + 1, owner_id, sensor_id, rule_type, op, 35.0::DOUBLE, unit, enabled FROM rules
) ru ON ru.sensor_id = r.sensor_id JOIN users us ON us.id = ru.owner_id
WHERE ru.enabled AND us.verified
  AND CASE WHEN ru.rule_type = 'EVENT_DETECTED' THEN coalesce(r.boolean_value, false)
           WHEN ru.op = 'ABOVE' THEN r.unit = ru.unit AND r.numeric_value > ru.threshold
           ELSE r.unit = ru.unit AND r.numeric_value < ru.threshold END""",
        ),
        "taken_on_write": _with(
            "raw_sensors",
            """
SELECT id, token_hash AS key_value FROM raw_sensors b
WHERE id % 3 = 0 AND EXISTS (SELECT 1 FROM raw_sensors h WHERE h.token_hash = b.token_hash AND h.id <> b.id)""",
        ),
        "missing_on_write": _with(
            "raw_rules sensors",
            "SELECT id AS rule_id, sensor_id FROM raw_rules WHERE sensor_id NOT IN (SELECT id FROM sensors)",
        ),
        "stream_cooldown_state": fired,
        "stream_log_to_alerts": fired,
        "readings_after_file_delete": f"SELECT * FROM ({ingest_rows}) WHERE sensor_id % 5 <> 1",
        "compacted_with_batch": f"SELECT * FROM ({ingest_rows}) WHERE sensor_id % 5 <> 1 AND (id % 2 = 0 OR id % 3 <> 0)",
        "stream_slots_late": rollup,
        "stream_alerts": fired,
        "stream_alerts_resumed": fired,
        "stored_rejects": _with(
            "classified", "SELECT id AS request_id, outcome FROM classified WHERE outcome = 'INVALID_TOKEN_401'"
        ),
        "stored_dimensions": _with(
            "sensors users rules",
            "SELECT 'sensors' AS table_name, id AS row_id FROM sensors UNION ALL SELECT 'app_users', id FROM users "
            "UNION ALL SELECT 'alert_rules', id FROM rules",
        ),
        "owner_sensors": _with("sensors", "SELECT id, owner_id, type FROM sensors WHERE owner_id = 3"),
        "rules_after_run": _with(
            "walk rules",
            """
SELECT r.id AS rule_id, f.last_triggered_at
FROM rules r
LEFT JOIN (SELECT rule_id, max(recorded_at) AS last_triggered_at FROM walk WHERE fired GROUP BY rule_id) f
  ON f.rule_id = r.id""",
        ),
        "daily_from_stored_rollup": _with(
            "readings sensors",
            f"""
SELECT s.id AS sensor_id, s.type AS sensor_type, CAST(d.day AS DATE) AS local_date,
       round(CASE WHEN s.type = 'MOTION' THEN coalesce(a.detections, 0)::DOUBLE ELSE a.average END, 6) AS value
FROM (SELECT *, CAST({_moved(_NOW, 'id', 'tz')} AS DATE) AS today FROM sensors) s,
     LATERAL (SELECT s.today - CAST(n AS INTEGER) AS day FROM range(7) t(n)) d
LEFT JOIN (SELECT r.sensor_id, CAST({_moved('r.recorded_at', 'q.id', 'q.tz')} AS DATE) AS day,
                  avg(r.numeric_value) AS average, count(*) FILTER (WHERE r.boolean_value) AS detections
           FROM readings r JOIN sensors q ON q.id = r.sensor_id GROUP BY ALL) a
  ON a.sensor_id = s.id AND a.day = d.day""",
        ),
        "after_user_delete": _with(
            "users sensors raw_readings rules challenges resets",
            """
SELECT 'app_users' AS table_name, id AS row_id FROM users WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sensors', id FROM sensors WHERE owner_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sensor_readings', id FROM raw_readings WHERE sensor_id NOT IN (SELECT id FROM gone_sensors)
UNION ALL SELECT 'alert_rules', id FROM rules
          WHERE owner_id NOT IN (SELECT id FROM gone) AND sensor_id NOT IN (SELECT id FROM gone_sensors)
UNION ALL SELECT 'email_verification_challenges', id FROM challenges WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'password_reset_challenges', id FROM resets WHERE user_id NOT IN (SELECT id FROM gone)""",
            {
                "gone": "SELECT id FROM users WHERE NOT verified",
                "gone_sensors": "SELECT id FROM sensors WHERE owner_id IN (SELECT id FROM gone)",
            },
        ),
        "stream_rollup": rollup,
    }
    # The same rows by other means.
    same = {
        "bucketed_recent": "recent_readings",
        "bucketed_rollup": "rollup_15m",
        "outcomes_from_log": "ingest_outcomes",
        "stream_cap_two_keys": "cap_two_keys",
        "stream_daily_series": "daily_stats_7d",
        "stream_hourly_series": "hourly_stats",
        "stream_recent": "recent_readings",
        "recent_from_days": "recent_readings",
        "retained_files": "retained_readings",
    }
    return {**texts, **{name: texts[other] for name, other in same.items()}}
