"""The catalog's queries as plain SQL for another engine: a self-join formulation, independent of the Spark plans."""

from __future__ import annotations

from riskloom.plans.catalog import STRICT_SETTINGS

_DEFAULTS = {
    "risk.anomaly-multiplier": "5",
    "risk.anomaly-min-history": "3",
    "risk.max-declined-per-five-minutes": "3",
    "risk.impossible-travel-minutes": "10",
    "risk.new-country-amount-multiplier": "2",
    "risk.new-country-min-history": "3",
    "risk.max-amount-per-ten-minutes": "5000",
    "risk.max-transactions-per-minute": "5",
}


def _tx(compression: int = 1_000, customer: str = "CAST(user_id AS VARCHAR)", extra: str = "") -> str:
    return f"""tx AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, {customer} AS customer,
    CAST(CAST(value AS DECIMAL(28,8)) * 4 AS DECIMAL(28,8)) AS amount,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 5 THEN 'US' ELSE 'PT' END AS country,
    event_type = 'error' AS declined,
    1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // {compression} AS ts_ms{extra}
  FROM events)"""


def _history(source: str, name: str = "ctx") -> str:
    """Context columns of ``source(id, customer, amount, country, declined, ts_ms)``."""
    return f"""{name}_o AS (
  SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts_ms, id) AS rn,
    row_number() OVER (PARTITION BY customer, ts_ms ORDER BY id) = 1 AS first_of_instant,
    CASE WHEN declined THEN 0 ELSE CAST(amount * 100000000 AS HUGEINT) END AS units
  FROM {source}),
{name}_p AS (
  SELECT t.id AS tid, t.ts_ms - p.ts_ms AS age, p.rn, p.country, p.declined, p.units
  FROM {name}_o t JOIN {name}_o p ON p.customer = t.customer AND p.rn BETWEEN t.rn - 100 AND t.rn - 1
    AND t.ts_ms - p.ts_ms <= 3600000 + CASE WHEN t.first_of_instant THEN 1 ELSE 0 END),
{_features(name)}"""


def _features(name: str) -> str:
    """Context columns from ``{name}_o``, rows, and ``{name}_p``, the history that each of them sees."""
    return f"""{name}_g AS (
  SELECT tid,
    count(*) FILTER (age < 60000) AS n_minute,
    count(*) FILTER (age < 300000 AND declined) AS n_declined,
    sum(units) FILTER (age < 600000) AS u_ten,
    string_agg(country, ',' ORDER BY rn) FILTER (age < 600000) AS recent,
    arg_max(country, rn) AS prev_country, arg_max(age, rn) AS since,
    count(*) FILTER (NOT declined) AS n, CAST(sum(units) AS HUGEINT) AS u,
    string_agg(DISTINCT country, ',' ORDER BY country) AS known
  FROM {name}_p GROUP BY tid),
{name} AS (
  SELECT t.*, 1 + coalesce(n_minute, 0) AS transactions_last_minute,
    (coalesce(u_ten, 0) + units) AS ten_units,
    CAST(coalesce(u_ten, 0) + units AS DOUBLE) / 100000000 AS amount_last_ten_minutes,
    prev_country AS previous_country, coalesce(recent, '') AS recent_countries,
    CASE WHEN n > 0 THEN (2 * u * 10000 + n * 100000000) // (2 * n * 100000000) END AS avg4,
    CASE WHEN n > 0 THEN CAST((2 * u * 10000 + n * 100000000) // (2 * n * 100000000) AS DOUBLE) / 10000 END
      AS average_recent_amount,
    coalesce(n, 0) AS recent_transaction_count, since AS time_since_previous_ms,
    coalesce(known, '') AS known_countries, coalesce(n_declined, 0) AS declined_last_five_minutes
  FROM {name}_o t LEFT JOIN {name}_g g ON g.tid = t.id)"""


def _rules(settings: dict[str, str], contexts: str = "ctx", name: str = "fired") -> str:
    s = _DEFAULTS | settings

    def above(multiplier: str, least: str) -> str:
        return (
            f"coalesce(avg4 > 0 AND recent_transaction_count >= {s[least]} AND "
            f"amount * 10000 > CAST(avg4 AS DECIMAL(28,0)) * {s[multiplier]}, false)"
        )

    return f"""{name} AS (
  SELECT *,
    {above("risk.anomaly-multiplier", "risk.anomaly-min-history")} AS r1,
    NOT declined AND declined_last_five_minutes >= {s["risk.max-declined-per-five-minutes"]} AS r2,
    coalesce(country <> previous_country AND time_since_previous_ms < 60000 * {s["risk.impossible-travel-minutes"]}, false)
      AS r3,
    NOT declined AND NOT list_contains(string_split(known_countries, ','), country)
      AND {above("risk.new-country-amount-multiplier", "risk.new-country-min-history")} AS r4,
    ten_units > CAST({s["risk.max-amount-per-ten-minutes"]} * 100000000.0 AS HUGEINT) AS r5,
    transactions_last_minute > {s["risk.max-transactions-per-minute"]} AS r6
  FROM {contexts})"""


_REASONS = {
    "r1": "UNUSUAL_AMOUNT",
    "r2": "FAILED_ATTEMPTS_THEN_SUCCESS",
    "r3": "GEOGRAPHIC_IMPOSSIBILITY",
    "r4": "NEW_COUNTRY_HIGH_AMOUNT",
    "r5": "HIGH_SPENDING_VELOCITY",
    "r6": "HIGH_TRANSACTION_VELOCITY",
}
_POINTS = {"r1": 30, "r2": 40, "r3": 50, "r4": 40, "r5": 40, "r6": 40}


def _scored(fired: str = "fired", name: str = "scored", more: dict[str, tuple[str, int]] | None = None) -> str:
    """``more`` has further rules, which come after the first: column, reason and points."""
    (first, *rest), more = _REASONS, more or {}
    texts = {first: _REASONS[first]} | {r: t for r, (t, _) in more.items()} | {r: _REASONS[r] for r in rest}
    points = _POINTS | {r: p for r, (_, p) in more.items()}
    total = " + ".join(f"CASE WHEN {r} THEN {p} ELSE 0 END" for r, p in points.items())
    reasons = ", ".join(f"CASE WHEN {r} THEN '{text}' END" for r, text in texts.items())
    documents = ", ".join(f"CASE WHEN {r} THEN '\"{text}\"' END" for r, text in texts.items())
    return f"""{name}_s AS (
  SELECT *, least(100, {total}) AS risk_score,
    concat_ws(',', {reasons}) AS reasons,
    '[' || concat_ws(',', {documents}) || ']' AS reasons_json
  FROM {fired}),
{name} AS (
  SELECT *, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
  FROM {name}_s)"""


def _instant(ts_ms: str) -> str:
    stamp = f"make_timestamp(CAST({ts_ms} * 1000 AS BIGINT))"
    return (
        f"CASE WHEN {ts_ms} % 1000 = 0 THEN strftime({stamp}, '%Y-%m-%dT%H:%M:%SZ') "
        f"ELSE strftime({stamp}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END"
    )


_MESSAGES = (
    _tx()
    + f""",
parts AS (
  SELECT *, event_id % 40 AS kind, CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR) AS amount_text,
    {_instant("ts_ms")} AS time_text,
    CAST(CASE WHEN event_id % 40 = 16 THEN event_id - 3 ELSE event_id END AS VARCHAR) AS own_id
  FROM tx),
msg AS (
  SELECT 'transaction.events' AS topic, CAST(event_id % 4 AS INTEGER) AS "partition", event_id // 4 AS "offset",
    CASE kind WHEN 0 THEN 'not json at all' WHEN 1 THEN '{{"amount":' WHEN 2 THEN '[1,2,3]' WHEN 3 THEN '"text"'
      WHEN 6 THEN '' WHEN 14 THEN NULL WHEN 10 THEN '{{"transactionId":"' || own_id || '"}}'
      ELSE '{{"transactionId":"' || CASE WHEN kind = 11 THEN ' \\t ' ELSE own_id END
        || '","customerId":"' || customer || '","merchantId":"merchant-1","amount":'
        || CASE kind WHEN 4 THEN '"abc"' WHEN 8 THEN '-' || amount_text WHEN 12 THEN '0' WHEN 16 THEN '1.25'
             WHEN 17 THEN '"' || amount_text || '"' WHEN 19 THEN '"1,000"' ELSE amount_text END
        || ',"currency":"' || CASE WHEN kind = 9 THEN 'JPY' ELSE 'EUR' END
        || '","country":' || CASE WHEN kind = 15 THEN '{{"a":1}}' ELSE '"' || country || '"' END
        || ',"timestamp":"' || CASE kind WHEN 5 THEN 'yesterday' WHEN 18 THEN rtrim(time_text, 'Z') ELSE time_text END
        || '"' || CASE WHEN kind = 7 THEN ',"paymentStatus":"MAYBE"' WHEN declined THEN ',"paymentStatus":"DECLINED"'
             ELSE '' END
        || CASE WHEN kind = 13 THEN ',"somethingNew":true' ELSE '' END || '}}' END AS payload
  FROM parts),
doc AS (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS j FROM msg),
typed AS (
  SELECT *, json_type(j) AS kind, j->>'$.transactionId' AS id, j->>'$.customerId' AS customer,
    j->>'$.merchantId' AS merchant, j->>'$.amount' AS amount_text, j->>'$.currency' AS currency,
    j->>'$.country' AS country, j->>'$.timestamp' AS time_text, j->>'$.paymentStatus' AS status
  FROM doc),
parsed_e AS (
  SELECT *, 'MALFORMED_PAYLOAD: ' || CASE
    WHEN payload IS NULL OR payload = '' THEN 'empty payload'
    WHEN j IS NULL THEN 'payload is not valid JSON'
    WHEN kind <> 'OBJECT' THEN 'payload is not a JSON object'
    WHEN json_type(j, '$.country') IN ('OBJECT', 'ARRAY') THEN 'country is not a text'
    WHEN NOT regexp_full_match(amount_text, '[+-]?[0-9]+(\\.[0-9]+)?') THEN 'amount is not a number'
    WHEN NOT regexp_full_match(time_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?Z')
      THEN 'timestamp is not an ISO-8601 instant'
    WHEN status NOT IN ('APPROVED', 'DECLINED') THEN 'paymentStatus is not a known value' END AS error
  FROM typed),
parsed AS (
  SELECT topic, "partition", "offset", payload, error, id, customer, merchant, currency, country, status,
    CASE WHEN error IS NULL THEN CAST(amount_text AS DECIMAL(28,8)) END AS amount,
    CASE WHEN error IS NULL THEN epoch_ms(CAST(rtrim(time_text, 'Z') AS TIMESTAMP)) END AS ts_ms,
    coalesce(status = 'DECLINED', false) AS declined
  FROM parsed_e)"""
)

_BLANK = "({0} IS NULL OR regexp_full_match({0}, '\\s*'))"
_INVARIANTS = [
    (_BLANK.format("id"), "PIPELINE_TRANSACTION_ID_MISSING", "'transactionId is required (deduplication key)'"),
    (_BLANK.format("customer"), "PIPELINE_CUSTOMER_ID_MISSING", "'customerId is required (partition key)'"),
    ("ts_ms IS NULL", "PIPELINE_TIMESTAMP_MISSING", "'timestamp is required (event time)'"),
]
_MINIMUM = [
    (
        "amount <= 0",
        "AMOUNT_NOT_POSITIVE",
        "'amount must be greater than 0 but was ' || regexp_replace(CAST(amount AS VARCHAR), '\\.?0+$', '')",
    )
]
_REQUIRED = [
    (condition, "REQUIRED_FIELD_MISSING", f"'required field is missing or blank: {field}'")
    for condition, field in [
        (_BLANK.format("id"), "transactionId"),
        (_BLANK.format("customer"), "customerId"),
        (_BLANK.format("merchant"), "merchantId"),
        (_BLANK.format("currency"), "currency"),
        ("amount IS NULL", "amount"),
        ("ts_ms IS NULL", "timestamp"),
    ]
]
_CURRENCY = [
    ("currency NOT IN ('EUR', 'USD', 'GBP')", "CURRENCY_NOT_SUPPORTED", "'currency not supported: ' || currency")
]


def _violations(checks: list[tuple[str, str, str]]) -> str:
    found = " UNION ALL ".join(
        f"""SELECT "partition", "offset", {n} AS ord, '{code}' AS code, {message} AS message
  FROM parsed WHERE error IS NULL AND {condition}"""
        for n, (condition, code, message) in enumerate(checks)
    )
    return f"""found AS ({found}),
violations AS (
  SELECT "partition", "offset", code, message, CAST(row_number() OVER (PARTITION BY "partition", "offset" ORDER BY ord) - 1
    AS INTEGER) AS position FROM found)"""


_DIGITS = "CASE WHEN regexp_full_match(id, '[0-9]+') THEN CAST(id AS BIGINT) % 50 END"
_CHECK_DIGIT = [
    (f"{_DIGITS} = 8", "CHECK_DIGIT", "'check digit of ' || id || ' is 8'"),
    (f"{_DIGITS} = 7", "RULE_ERROR", "'CheckDigitRule failed: ValueError(' || chr(39) || 'no check digit for ' || id || chr(39) || ')'"),
]
_ALL_CHECKS = _INVARIANTS + _MINIMUM + _REQUIRED + _CURRENCY
_CHECKED = (
    f"{_MESSAGES}, {_violations(_ALL_CHECKS)}"
    + """,
joined AS (
  SELECT "partition", "offset", string_agg(code, ',' ORDER BY position) AS codes,
    string_agg(message, '; ' ORDER BY position) AS messages
  FROM violations GROUP BY ALL),
checked AS (SELECT p.*, codes, messages FROM parsed p LEFT JOIN joined v USING ("partition", "offset")),
valid AS (SELECT * FROM checked WHERE error IS NULL AND codes IS NULL),
letters AS (
  SELECT CASE WHEN error IS NOT NULL THEN 'DESERIALIZATION' ELSE 'VALIDATION' END AS source,
    CASE WHEN error IS NOT NULL THEN 'MALFORMED_PAYLOAD' ELSE codes END AS code,
    CASE WHEN error IS NOT NULL THEN error ELSE messages END AS detail,
    CASE WHEN error IS NULL THEN id END AS transaction_id,
    coalesce(payload, '') AS payload, topic, "partition", "offset"
  FROM checked WHERE error IS NOT NULL OR codes IS NOT NULL),
uniq AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY topic, "partition", "offset") = 1)"""
)

_SHOW_VIOLATIONS = 'SELECT "partition", "offset", position, code, message FROM violations'


def _one_rule(checks: list[tuple[str, str, str]]) -> str:
    return f"WITH {_MESSAGES}, {_violations(checks)} {_SHOW_VIOLATIONS}"


_CTX = f"WITH {_tx()}, {_history('tx')}"
_FIRED = f"{_CTX}, {_rules({})}"
_SCORED = f"{_FIRED}, {_scored()}"
_CONTEXT_SHOWN = (
    "transactions_last_minute, amount_last_ten_minutes, previous_country, recent_countries, average_recent_amount, "
    "recent_transaction_count, time_since_previous_ms, known_countries, declined_last_five_minutes"
)


def _feature(columns: str) -> str:
    return f"{_CTX} SELECT id AS transaction_id, {columns} FROM ctx"


def _dense(compression: int) -> str:
    tx = _tx(compression, customer="CAST(user_id % 20 AS VARCHAR)")
    return f"WITH {tx}, {_history('tx')} SELECT id AS transaction_id, {_CONTEXT_SHOWN} FROM ctx"


def _triggered(rule: str) -> str:
    return (
        f"{_FIRED} SELECT id AS transaction_id, CASE WHEN {rule} THEN {_POINTS[rule]} ELSE 0 END AS score, "
        f"CASE WHEN {rule} THEN '{_REASONS[rule]}' END AS reason FROM fired"
    )


_RESULT = "SELECT id AS transaction_id, customer AS customer_id, risk_score, risk_level, reasons, ts_ms FROM scored"
_ARRIVALS = f"""{_tx(extra=", event_id // 1000 + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS arrival_batch")},
batches AS (SELECT arrival_batch, max(ts_ms) AS newest FROM tx GROUP BY arrival_batch),
marks AS (
  SELECT b.arrival_batch, max(e.newest) - 30000 AS watermark_ms
  FROM batches b LEFT JOIN batches e ON e.arrival_batch < b.arrival_batch GROUP BY b.arrival_batch),
arrived AS (SELECT tx.*, watermark_ms FROM tx JOIN marks USING (arrival_batch))"""
_SOURCES = f"""{_tx()}, placed AS (
  SELECT *, CASE WHEN (event_id // 100) // 12 % 2 = 1 AND event_id % 4 = 3 THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS source FROM tx),
sent AS (SELECT *, event_id // 100 + CASE WHEN source = 2 THEN 2 ELSE 0 END AS arrival_batch FROM placed),
steps AS (SELECT DISTINCT arrival_batch, arrival_batch * 4000 AS now FROM sent),
reports AS (SELECT arrival_batch, source, max(ts_ms) AS newest FROM sent GROUP BY ALL),
held AS (
  SELECT s.arrival_batch, s.now, p.source, max(r.newest) AS newest,
    coalesce(max(r.arrival_batch) * 4000, (SELECT min(now) FROM steps)) AS heard
  FROM steps s CROSS JOIN (SELECT DISTINCT source FROM sent) p
  LEFT JOIN reports r ON r.source = p.source AND r.arrival_batch < s.arrival_batch GROUP BY s.arrival_batch, s.now, p.source),
low AS (
  SELECT arrival_batch, CASE WHEN count(newest) = count(*) THEN min(newest) END AS least
  FROM held WHERE now - heard < 30000 GROUP BY arrival_batch),
part_marks AS (
  SELECT s.arrival_batch, max(least) OVER (ORDER BY s.arrival_batch) AS top FROM steps s LEFT JOIN low l ON l.arrival_batch = s.arrival_batch)"""
# The log of plans/streams.py: its order, its batches, and what each batch finds behind the watermark. A row on time is
# evaluated by the first batch whose watermark has reached it, before the rows that this batch brings.
_STREAM = f"""{_CHECKED}, size AS (SELECT max(event_id) + 1 AS n FROM events),
log AS (
  SELECT event_id, event_id % 4 AS p, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id
    + CASE WHEN event_id % 11 = 0 THEN n // 5 WHEN event_id % 7 = 0 THEN n // 20 ELSE 0 END, event_id) - 1 AS o,
    o // ((n + 39) // 40) AS batch
  FROM events, size),
brought AS (
  SELECT v.id, v.customer, v.amount, v.country, v.declined, v.ts_ms, log.batch, log.p, log.o
  FROM valid v JOIN log ON log.event_id = v."offset" * 4 + v."partition"
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY log.batch, log.p, log.o) = 1),
turns AS (SELECT unnest(generate_series(0, (SELECT max(batch) + 1 FROM log))) AS batch),
newest AS (SELECT batch, max(ts_ms) AS top FROM brought GROUP BY batch),
mark AS (
  SELECT t.batch, coalesce(max(n.top) - 30000, 0) AS w
  FROM turns t LEFT JOIN newest n ON n.batch < t.batch GROUP BY t.batch),
judged AS (
  SELECT b.*, k.w, CASE WHEN b.ts_ms > k.w THEN 'ON_TIME' WHEN b.ts_ms > k.w - 300000 THEN 'TOLERATED' ELSE 'LATE' END AS lateness
  FROM brought b JOIN mark k ON k.batch = b.batch),
timed AS (
  SELECT j.*, CASE WHEN lateness = 'ON_TIME' THEN (SELECT min(k.batch) FROM mark k WHERE k.w >= j.ts_ms) ELSE batch END AS done
  FROM judged j),
ctx_o AS (
  SELECT *, row_number() OVER (ORDER BY done, lateness = 'TOLERATED', CASE WHEN lateness = 'ON_TIME' THEN ts_ms END,
      CASE WHEN lateness = 'ON_TIME' THEN id END, p, o) AS seq,
    CASE WHEN declined THEN 0 ELSE CAST(amount * 100000000 AS HUGEINT) END AS units
  FROM timed WHERE done IS NOT NULL AND lateness <> 'LATE'),
seen AS (
  SELECT t.id AS tid, t.ts_ms - s.ts_ms AS age, s.country, s.declined, s.units, t.lateness, t.w - s.ts_ms AS behind,
    row_number() OVER (PARTITION BY t.id ORDER BY s.ts_ms DESC, s.seq DESC) AS back, max(s.ts_ms) OVER (PARTITION BY t.id) < t.ts_ms AS opens
  FROM ctx_o t JOIN ctx_o s ON s.customer = t.customer AND s.seq < t.seq),
ctx_p AS (
  SELECT *, -back AS rn FROM seen WHERE back <= 100 AND age >= 0
    AND CASE WHEN lateness = 'ON_TIME' THEN age <= 3600000 + CASE WHEN opens THEN 1 ELSE 0 END ELSE behind <= 3600000 END),
{_features('ctx')}"""
_TABLE_COLUMNS = f"{_instant('ts_ms')} AS event_time"
_REPLAY = f"""{_SCORED}, {_rules(STRICT_SETTINGS, name="strict_fired")}, {_scored("strict_fired", "strict")},
record AS (
  SELECT id, risk_score, risk_level, reasons_json FROM strict WHERE event_id % 3 <> 0
  UNION ALL
  SELECT id, risk_score, risk_level, reasons_json FROM scored WHERE event_id % 3 = 0)"""


def oracle() -> dict[str, str]:
    return {
        "parsed_messages": f"""WITH {_MESSAGES}
SELECT "partition", "offset", id AS transaction_id, customer AS customer_id, merchant AS merchant_id,
  CAST(amount AS DOUBLE) AS amount, currency, country, ts_ms, status AS payment_status
FROM parsed WHERE error IS NULL""",
        "malformed_messages": f"""WITH {_MESSAGES}
SELECT topic, "partition", "offset", error, coalesce(payload, '') AS payload FROM parsed WHERE error IS NOT NULL""",
        "all_violations": _one_rule(_ALL_CHECKS),
        "invariant_violations": _one_rule(_INVARIANTS),
        "minimum_amount_violations": _one_rule(_MINIMUM),
        "required_field_violations": _one_rule(_REQUIRED),
        "supported_currency_violations": _one_rule(_CURRENCY),
        "rule_errors": _one_rule(_INVARIANTS + _CHECK_DIGIT + _MINIMUM + _REQUIRED + _CURRENCY),
        "lossy_payloads": f"""WITH {_MESSAGES}
SELECT "partition", "offset", 'MALFORMED_PAYLOAD: payload is not valid UTF-8' AS error, payload || CASE WHEN "offset" % 4 < 2 THEN chr(65533) ELSE ' ' || chr(65533) END AS payload
FROM parsed WHERE payload = 'not json at all'""",
        "valid_transactions": f"""WITH {_CHECKED}
SELECT "partition", "offset", id AS transaction_id, customer AS customer_id, CAST(amount AS DOUBLE) AS amount, ts_ms
FROM valid""",
        "dead_letters": f"WITH {_CHECKED} SELECT * FROM letters",
        "message_counters": f"""WITH {_CHECKED}
SELECT count(*) FILTER (error IS NULL AND codes IS NULL) AS transactions_valid,
  count(*) FILTER (error IS NULL AND codes IS NOT NULL) AS transactions_rejected,
  count(*) FILTER (error IS NOT NULL) AS messages_malformed FROM checked""",
        "unique_transactions": f"""WITH {_CHECKED}
SELECT id AS transaction_id, "partition", "offset", customer AS customer_id, CAST(amount AS DOUBLE) AS amount FROM uniq""",
        "duplicate_counter": f"""WITH {_CHECKED}
SELECT count(*) - count(DISTINCT id) AS duplicates_dropped FROM valid""",
        "transactions_last_minute": _feature("transactions_last_minute"),
        "amount_last_ten_minutes": _feature("amount_last_ten_minutes"),
        "previous_transaction": _feature("previous_country, time_since_previous_ms"),
        "recent_countries": _feature("recent_countries"),
        "average_recent_amount": _feature("average_recent_amount, recent_transaction_count"),
        "known_countries": _feature("known_countries"),
        "declined_last_five_minutes": _feature("declined_last_five_minutes"),
        "risk_context": _feature(_CONTEXT_SHOWN),
        "bounded_history": _dense(1_000),
        "retained_history": _dense(100),
        "rule_amount_anomaly": _triggered("r1"),
        "rule_failed_attempts": _triggered("r2"),
        "rule_geographic_impossibility": _triggered("r3"),
        "rule_new_country": _triggered("r4"),
        "rule_spending_velocity": _triggered("r5"),
        "rule_transaction_velocity": _triggered("r6"),
        "risk_results": f"{_SCORED} {_RESULT}",
        "risk_results_strict": f"{_CTX}, {_rules(STRICT_SETTINGS)}, {_scored()} {_RESULT}",
        "risk_level_counts": f"{_SCORED} SELECT risk_level, count(*) AS transactions FROM scored GROUP BY risk_level",
        "extended_results": f"""{_FIRED}, more AS (SELECT *, CAST(customer AS BIGINT) % 2 = 0 AS r7 FROM fired),
{_scored("more", "scored", {"r7": ("EVEN_CUSTOMER", 35)})}
SELECT id AS transaction_id, risk_score, risk_level, reasons FROM scored""",
        "reason_counts": f"""{_SCORED}, each AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM scored)
SELECT reason, count(*) AS transactions FROM each WHERE reason <> '' GROUP BY reason""",
        "high_risk_alerts": f"""{_SCORED}
SELECT 'high-risk-v1-' || id AS alert_id, id AS transaction_id, customer AS customer_id, risk_score, risk_level, reasons,
  ts_ms AS transaction_ts_ms FROM scored WHERE risk_score >= 70""",
        "end_to_end_results": f"""WITH {_CHECKED}, {_history("uniq")}, {_rules({})}, {_scored()}
SELECT id AS transaction_id, customer AS customer_id, risk_score, risk_level, reasons FROM scored""",
        "late_transactions": f"""WITH {_ARRIVALS}
SELECT id AS transaction_id, arrival_batch, watermark_ms,
  CASE WHEN watermark_ms IS NULL OR ts_ms > watermark_ms THEN 'ON_TIME'
    WHEN ts_ms > watermark_ms - 120000 THEN 'TOLERATED' ELSE 'LATE' END AS lateness
FROM arrived""",
        "partition_watermarks": f"WITH {_SOURCES} SELECT arrival_batch, top - 30000 AS watermark_ms FROM part_marks",
        "partition_lateness": f"""WITH {_SOURCES}
SELECT id AS transaction_id, s.arrival_batch, source, top - 5000 AS watermark_ms,
  CASE WHEN top IS NULL OR ts_ms > top - 5000 THEN 'ON_TIME' WHEN ts_ms > top - 25000 THEN 'TOLERATED' ELSE 'LATE' END AS lateness
FROM sent s JOIN part_marks m ON m.arrival_batch = s.arrival_batch""",
        "tolerated_results": f"""WITH {_ARRIVALS},
in_time AS (SELECT * FROM arrived WHERE watermark_ms IS NULL OR ts_ms > watermark_ms - 120000),
{_history("in_time")}, {_rules({})}, {_scored()}
SELECT s.id AS transaction_id, s.risk_score, s.risk_level, s.reasons FROM scored s JOIN arrived a ON a.id = s.id
WHERE a.ts_ms <= a.watermark_ms""",
        "outcome_counters": f"""WITH {_ARRIVALS},
in_time AS (SELECT * FROM arrived WHERE watermark_ms IS NULL OR ts_ms > watermark_ms - 120000),
{_history("in_time")}, {_rules({})}, {_scored()}
SELECT (SELECT count(*) FROM scored) AS risk_evaluated,
  (SELECT count(*) FROM scored WHERE risk_level = 'HIGH') AS high_risk_alerts,
  (SELECT count(*) FROM arrived WHERE ts_ms <= watermark_ms - 120000) AS late_events,
  (SELECT count(*) FROM arrived WHERE ts_ms <= watermark_ms AND ts_ms > watermark_ms - 120000) AS late_events_tolerated""",
        "unique_by_arrival": f"""WITH {_ARRIVALS}
SELECT id AS transaction_id, arrival_batch - CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS arrival_batch,
  CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 0 ELSE 1 END AS "partition" FROM arrived""",
        "persistable_events": f"""WITH {_ARRIVALS},
in_time AS (SELECT * FROM arrived WHERE watermark_ms IS NULL OR ts_ms > watermark_ms),
{_history("in_time")}, {_rules({})}, {_scored()}
SELECT id AS transaction_id, 'PROCESSED' AS status, risk_score, risk_level, reasons, risk_score >= 70 AS raise_alert
FROM scored
UNION ALL
SELECT id, 'LATE', NULL, NULL, NULL, false FROM arrived WHERE ts_ms <= watermark_ms""",
        "risk_result_documents": f"""{_SCORED}
SELECT customer AS key, '{{"transactionId":"' || id || '","customerId":"' || customer || '","riskScore":' || risk_score
  || ',"riskLevel":"' || risk_level || '","reasons":' || reasons_json || ',"timestamp":"' || {_instant("ts_ms")} || '"}}'
  AS value FROM scored""",
        "alert_documents": f"""{_SCORED}
SELECT customer AS key, '{{"alertId":"high-risk-v1-' || id || '","transactionId":"' || id || '","customerId":"' || customer
  || '","riskScore":' || risk_score || ',"riskLevel":"' || risk_level || '","reasons":' || reasons_json
  || ',"transactionTimestamp":"' || {_instant("ts_ms")} || '"}}' AS value FROM scored WHERE risk_score >= 70""",
        "dead_letter_documents": f"""WITH {_CHECKED}
SELECT transaction_id AS key, '{{"source":"' || source || '","code":"' || code || '","detail":"' || detail
  || '","transactionId":' || coalesce(CAST(to_json(transaction_id) AS VARCHAR), 'null')
  || ',"payload":' || CAST(to_json(payload) AS VARCHAR) || ',"topic":"' || topic || '","partition":' || "partition"
  || ',"offset":' || "offset" || ',"detectedAt":"2027-03-02T08:20:07Z"}}' AS value FROM letters""",
        "stored_transactions": f"""{_SCORED}
SELECT id AS transaction_id, customer AS customer_id, 'merchant-1' AS merchant_id,
  CAST(CAST(amount AS DECIMAL(19,4)) AS DOUBLE) AS amount, 'EUR' AS currency, country, {_TABLE_COLUMNS},
  'PROCESSED' AS status, CASE WHEN declined THEN 'DECLINED' ELSE 'APPROVED' END AS payment_status FROM scored""",
        "stored_scores": f"""{_SCORED}
SELECT id AS transaction_id, customer AS customer_id, risk_score, risk_level, reasons_json AS reasons, {_TABLE_COLUMNS}
FROM scored""",
        "rejected_records": f"""WITH {_tx()}, judged AS (
  SELECT id, CASE
    WHEN event_id % 17 = 0 THEN 'merchant_id must not be null'
    WHEN event_id % 23 = 0 AND length(repeat(customer, 101)) > 100 THEN 'customer_id is longer than 100'
    WHEN event_id % 13 = 0 THEN 'currency is longer than 3'
    WHEN event_id % 11 = 0 THEN 'country is longer than 2'
    WHEN event_id % 19 = 0 THEN 'amount does not fit NUMERIC(19,4)' END AS rejection FROM tx)
SELECT id AS transaction_id, rejection FROM judged WHERE rejection IS NOT NULL""",
        "flush_batches": f"""WITH RECURSIVE {_tx(1_000_000)}, sent AS (
  SELECT event_id, ts_ms, CASE WHEN event_id % 3 <> 0 THEN 'hot' ELSE 'w' || (CAST(customer AS BIGINT) % 5) END AS key FROM tx),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, event_id) AS place FROM sent),
closed AS (
  SELECT *, least(place + 500, max(place) OVER (PARTITION BY key ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND 199 FOLLOWING) + 1) AS next
  FROM placed),
opened AS (
  SELECT key, place, next, 1 AS batch FROM closed WHERE place = 1
  UNION ALL
  SELECT c.key, c.place, c.next, o.batch + 1 FROM opened o JOIN closed c ON c.key = o.key AND c.place = o.next)
SELECT o.key, CAST(o.batch AS BIGINT) AS batch, o.next - o.place AS rows, f.event_id AS first_id, f.ts_ms AS first_ms, l.ts_ms AS last_ms
FROM opened o JOIN placed f ON f.key = o.key AND f.place = o.place JOIN placed l ON l.key = o.key AND l.place = o.next - 1""",
        "first_write_scores": f"""{_REPLAY}
SELECT id AS transaction_id, risk_score, risk_level, reasons_json AS reasons FROM record""",
        "ledger_counters": """SELECT CAST(2 AS BIGINT) AS batches_written, count(*) FILTER (event_id % 19 <> 0) AS rows_written,
  count(*) FILTER (event_id % 19 = 0) + count(*) FILTER (event_id % 19 = 0 AND event_id % 3 <> 0) AS records_skipped,
  count(*) FILTER (event_id % 19 <> 0) AS rows_stored, count(*) FILTER (event_id % 19 <> 0) AS ids_stored FROM events""",
        "indexed_first_write_scores": f"""{_REPLAY}
SELECT id AS transaction_id, risk_score, risk_level, reasons_json AS reasons FROM record""",
        "first_write_alerts": f"""{_REPLAY}
SELECT r.id AS transaction_id, r.risk_score, r.risk_level, r.reasons_json AS reasons
FROM record r JOIN scored s ON s.id = r.id AND s.risk_level = r.risk_level WHERE s.risk_level = 'HIGH'""",
        "log_records": f"""WITH {_MESSAGES}, size AS (SELECT max(event_id) + 1 AS n FROM events),
log AS (
  SELECT event_id % 4 AS p, event_id // 4 AS sent, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id
    + CASE WHEN event_id % 11 = 0 THEN n // 5 WHEN event_id % 7 = 0 THEN n // 20 ELSE 0 END, event_id) - 1 AS o
  FROM events, size)
SELECT m.topic, m."partition", o AS "offset", coalesce(m.payload, '') AS payload
FROM log JOIN msg m ON m."partition" = log.p AND m."offset" = log.sent""",
        "stream_results": f"""WITH {_STREAM}, {_rules({})}, {_scored()}
SELECT id AS transaction_id, customer AS customer_id, lateness, risk_score, risk_level, reasons, recent_transaction_count AS history_count
FROM scored
UNION ALL
SELECT id, customer, lateness, NULL, NULL, NULL, NULL FROM timed WHERE lateness = 'LATE'""",
        "stream_state": f"""WITH {_STREAM}
SELECT customer AS customer_id, count(*) FILTER (done IS NULL) AS waiting, least(100, count(*) FILTER (done IS NOT NULL)) AS history
FROM timed WHERE lateness <> 'LATE' GROUP BY customer""",
    }
