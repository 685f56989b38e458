"""DuckDB oracle SQL for every registered analysis.

Each oracle is ``PRELUDE`` (common table expressions that rebuild the raw
inputs from the pre-registered ``events`` and ``customer`` views, exactly as
``sources.fixtures`` does) followed by one query.  The lifecycle questions
are put in DuckDB's own terms, in four pieces that the catalogs share: the
receipt in force is an ``ASOF JOIN``, spend is a difference of two running
totals found by ``ASOF JOIN``, the next completion, view or receipt is a window
over all marks of a person and offer, and later receipts are the list such a
window gathers.  Money sums are done in DECIMAL(28,10) like the Spark
side; every ``1.0 * a / b`` is a DOUBLE with NULLIF on the divisor.
"""

from __future__ import annotations

# --- fixed values shared with sources.fixtures (FIXTURES.md §2) -----------
PRELUDE = r"""
offer_attrs(id, reward, difficulty, duration, offer_type, channels) AS (
  VALUES ('offer_0', 10, 10, 7.0::DOUBLE, 'bogo', ['email','mobile','social']),
         ('offer_1', 10, 10, 5.0::DOUBLE, 'bogo', ['web','email','mobile','social']),
         ('offer_2', 0, 0, 4.0::DOUBLE, 'informational', ['web','email','mobile']),
         ('offer_3', 5, 5, 7.0::DOUBLE, 'bogo', ['web','email','mobile']),
         ('offer_4', 5, 20, 10.0::DOUBLE, 'discount', ['web','email']),
         ('offer_5', 3, 7, 7.0::DOUBLE, 'discount', ['web','email','mobile','social']),
         ('offer_6', 2, 10, 10.0::DOUBLE, 'discount', ['web','email','mobile','social']),
         ('offer_7', 0, 0, 3.0::DOUBLE, 'informational', ['email','mobile','social']),
         ('offer_8', 5, 5, 5.0::DOUBLE, 'bogo', ['web','email','mobile','social']),
         ('offer_9', 2, 10, 7.0::DOUBLE, 'discount', ['web','email','mobile'])
),
ev_k AS (
  SELECT e.*, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
         CAST(date_sub('hour', TIMESTAMP '2024-01-01 00:00:00', CAST(e.ts AS TIMESTAMP)) AS INTEGER) AS h
  FROM events e
),
portfolio AS (
  SELECT id, CAST(reward AS INTEGER) reward, CAST(difficulty AS INTEGER) difficulty, duration, offer_type, channels
  FROM offer_attrs WHERE id IN (SELECT 'offer_' || CAST(k % 10 AS VARCHAR) FROM ev_k)
),
profile AS (
  SELECT
    CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 64 = 63 THEN 'O'
         WHEN c_custkey % 7 < 4 THEN 'M' ELSE 'F' END AS gender,
    CAST(CASE WHEN c_custkey % 8 = 0 THEN 118
         ELSE 18 + CAST(floor(pow(CAST((c_custkey * 37) % 84 AS DOUBLE), 4) / 592704.0) AS INTEGER) END AS INTEGER) AS age,
    'person_' || CAST(c_custkey AS VARCHAR) AS id,
    CAST((2013 + c_custkey % 6) * 10000 + (1 + c_custkey % 12) * 100 + 1 + c_custkey % 28 AS INTEGER) AS became_member_on,
    CASE WHEN c_custkey % 8 = 0 THEN NULL
         ELSE CAST(30000 + 1000 * floor(pow(CAST((c_custkey * 53) % 91 AS DOUBLE), 4) / 729000.0) AS DOUBLE) END AS income
  FROM customer
),
tr_base AS (
  SELECT CASE WHEN user_id % 50 = 49 THEN 'stranger_' ELSE 'person_' END || CAST(user_id AS VARCHAR) AS person,
    CASE WHEN event_type = 'purchase' AND user_id % 20 <> 17 THEN 'transaction'
         WHEN event_type = 'view' AND user_id % 20 <> 18 THEN 'offer viewed'
         WHEN event_type = 'click' AND user_id % 20 <> 19 THEN 'offer completed'
         ELSE 'offer received' END AS event,
    h - h % 6 AS time,
    'offer_' || CAST(CASE WHEN k >= 98 THEN k ELSE k % 10 END AS VARCHAR) AS oid,
    CASE WHEN event_id % 97 = 0 THEN 99 ELSE [10, 10, 0, 5, 5, 3, 2, 0, 5, 2][k % 10 + 1] END AS rw,
    value AS v
  FROM ev_k
),
transcript AS (
  SELECT person, event,
    CASE WHEN event = 'transaction' THEN '{''amount'': ' || CAST(v AS VARCHAR) || '}'
         WHEN event = 'offer completed' THEN '{''offer_id'': ''' || oid || ''', ''reward'': ' || CAST(rw AS VARCHAR) || '}'
         ELSE '{''offer id'': ''' || oid || '''}' END AS value,
    CAST(time AS INTEGER) AS time
  FROM tr_base
),
flat AS (
  SELECT person, event, time,
    COALESCE(NULLIF(json_extract_string(j, '$.offer_id'), ''), json_extract_string(j, '$."offer id"')) AS offer_id,
    CAST(json_extract(j, '$.amount') AS DOUBLE) AS amount,
    CAST(json_extract(j, '$.reward') AS DOUBLE) AS reward
  FROM (SELECT *, replace(value, '''', '"') AS j FROM transcript)
),
ev AS (SELECT DISTINCT person, event, time, offer_id, amount, reward FROM flat),
offer_received AS (SELECT person, offer_id, event, time FROM ev WHERE event = 'offer received'),
offer_viewed AS (SELECT person, offer_id, event, time FROM ev WHERE event = 'offer viewed'),
transaction_done AS (SELECT person, event, amount, time FROM ev WHERE event = 'transaction'),
offer_completed AS (SELECT person, offer_id, event, reward, time FROM ev WHERE event = 'offer completed'),
portfolio_cleaned AS (
  SELECT id, offer_type, reward, difficulty, duration,
    CAST(list_contains(channels, 'email') AS INTEGER) AS email,
    CAST(list_contains(channels, 'mobile') AS INTEGER) AS mobile,
    CAST(list_contains(channels, 'social') AS INTEGER) AS social,
    CAST(list_contains(channels, 'web') AS INTEGER) AS web
  FROM portfolio
),
profile_dated AS (
  SELECT gender, age, id, CAST(strptime(CAST(became_member_on AS VARCHAR), '%Y%m%d') AS DATE) AS became_member_on, income
  FROM profile
),
p_age AS (
  SELECT gender,
    CASE WHEN age = 118 THEN (SELECT CAST(trunc(avg(age)) AS INTEGER) FROM profile_dated WHERE age <> 118) ELSE age END AS age,
    id, became_member_on, income
  FROM profile_dated
),
p_gender AS (
  SELECT COALESCE(gender, CASE WHEN rnd <= 0.41 THEN 'F' WHEN rnd <= 0.98 THEN 'M' ELSE 'O' END) AS gender,
    age, id, became_member_on, income
  FROM (SELECT *, CAST(('0x' || substr(md5(id), 1, 8))::BIGINT % 10000 AS DOUBLE) / 10000.0 AS rnd FROM p_age)
),
p_band AS (
  SELECT *, CASE WHEN age < 30 THEN 'Under 30' WHEN age BETWEEN 30 AND 45 THEN '30-45'
                 WHEN age BETWEEN 46 AND 60 THEN '46-60' WHEN age BETWEEN 61 AND 75 THEN '61-75'
                 ELSE '76+' END AS age_group
  FROM p_gender
),
p_median AS (
  SELECT gender, age_group, quantile_cont(income, 0.5) AS median_income
  FROM p_band WHERE income IS NOT NULL GROUP BY gender, age_group
),
profile_cleaned AS (
  SELECT b.gender, b.age, b.id, b.became_member_on, COALESCE(b.income, m.median_income) AS income
  FROM p_band b LEFT JOIN p_median m ON b.gender = m.gender AND b.age_group = m.age_group
)
"""


def with_prelude(query: str) -> str:
    """Prefix a query (which may start with its own ``WITH x AS (...)``)."""
    q = query.strip()
    if q[:4].upper() == "WITH":
        return "WITH " + PRELUDE.strip() + ",\n" + q[4:].lstrip()
    return "WITH " + PRELUDE.strip() + "\n" + q


# --- pieces of the lifecycle questions ------------------------------------
# rec, comp, view, txn: names of the relations to read.

def receipts(rec: str = "offer_received") -> str:
    return f"(SELECT DISTINCT person, offer_id, time AS got FROM {rec})"


def in_force(keys: str, at: str, rec: str = "offer_received", kind: str = "") -> str:
    """``keys`` k with ``got``: the receipt in force at ``at`` (``kind``:
    '' or 'LEFT')."""
    return (f"SELECT k.*, r.got FROM ({keys}) k ASOF {kind} JOIN {receipts(rec)} r "
            f"ON k.person = r.person AND k.offer_id = r.offer_id AND k.{at} >= r.got")


def marks(rec: str = "offer_received", comp: str = "offer_completed", view: str | None = None) -> str:
    """Every receipt with what comes next: receipt, completion, view."""
    parts = [f"SELECT DISTINCT person, offer_id, time, '{k}' AS kind FROM {src}" for k, src in (("r", rec), ("c", comp), ("v", view)) if src]
    next_ = ", ".join(f"MIN(time) FILTER (kind = '{k}') OVER (here RANGE BETWEEN {start} AND UNBOUNDED FOLLOWING) AS {name}"
                      for k, start, name in (("r", "1 FOLLOWING", "next_got"), ("c", "CURRENT ROW", "next_done"), ("v", "CURRENT ROW", "next_view"))
                      if k != "v" or view)
    return (f"SELECT * FROM (SELECT *, {next_}, list(time) FILTER (kind = 'r') OVER (here RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later "
            f"FROM ({' UNION ALL '.join(parts)}) WHERE person IS NOT NULL WINDOW here AS (PARTITION BY person, offer_id ORDER BY time)) WHERE kind = 'r'")


def windows(rec: str = "offer_received", comp: str = "offer_completed") -> str:
    """``marks`` of catalogue offers with the end of the receipt's validity
    (expiry_time) and of its window (end_time: a completion inside it, if any)."""
    return (f"SELECT m.*, m.time + 24 * p.duration AS expiry_time, least(m.time + 24 * p.duration, m.next_done) AS end_time "
            f"FROM ({marks(rec, comp)}) m JOIN portfolio_cleaned p ON p.id = m.offer_id")


def spent(rows: str, until: str, txn: str = "transaction_done") -> str:
    """``rows`` (with person and got) plus ``n_txn`` and ``spent`` of the
    person's purchases from ``got`` to ``until``."""
    totals = (f"(SELECT person, time, SUM(amt) OVER up AS amt, SUM(n) OVER up AS n FROM "
              f"(SELECT person, time, SUM(CAST(amount AS DECIMAL(28,10))) AS amt, COUNT(amount) AS n FROM {txn} GROUP BY ALL) "
              f"WINDOW up AS (PARTITION BY person ORDER BY time))")
    return (f"SELECT x.*, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_txn, coalesce(b.amt, 0) - coalesce(a.amt, 0) AS spent FROM ({rows}) x "
            f"ASOF LEFT JOIN {totals} b ON x.person = b.person AND x.{until} >= b.time "
            f"ASOF LEFT JOIN {totals} a ON x.person = a.person AND x.got > a.time")


def completions(comp: str = "offer_completed") -> str:
    """Completions by key: rows at the key, and how many rewards they name."""
    return (f"SELECT person, offer_id, time AS completed_time, COUNT(*) AS n_rows, "
            f"COUNT(DISTINCT reward) + MAX((reward IS NULL)::INT) AS n_rewards FROM {comp} GROUP BY ALL")


def held_completions(rec: str = "offer_received", comp: str = "offer_completed") -> str:
    """``completions`` of catalogue offers with their receipt in force."""
    return (f"SELECT h.*, h.got AS received_time, h.got + 24 * p.duration AS expiry_time, p.difficulty "
            f"FROM ({in_force(completions(comp), 'completed_time', rec)}) h JOIN portfolio_cleaned p ON p.id = h.offer_id")


def short_of(until: str, total: str, columns: str, rec: str = "offer_received", comp: str = "offer_completed",
             txn: str = "transaction_done", where: str = "true") -> str:
    """``columns`` of the held completions whose ``total`` (over n_txn, spent,
    n_rows, n_rewards) is below the difficulty."""
    return (f"SELECT {columns} FROM (SELECT *, {total} AS total FROM ({spent(held_completions(rec, comp), until, txn)})) "
            f"WHERE total < difficulty AND {where}")


def known(times: str = "1") -> str:
    """Spend as a double, NULL if nothing was bought."""
    return f"CASE WHEN n_txn > 0 THEN CAST(spent * {times} AS DOUBLE) END"
