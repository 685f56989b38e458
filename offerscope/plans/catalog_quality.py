"""Discrepancy rules: each analysis returns the violating rows.

Spark side: ``plans.quality`` (as-of frame + running sums).  Oracle side:
``ASOF JOIN`` and list windows, from the pieces in ``plans.oracle``."""

from __future__ import annotations


from ..sources import tables
from . import oracle, quality
from .context import Tables
from .registry import analysis


@analysis("dq_orphan_offer", """
SELECT person, event, time, offer_id, amount, reward FROM ev
WHERE event <> 'transaction' AND coalesce(offer_id, '') NOT IN (SELECT id FROM portfolio_cleaned)""")
def orphan_offer(t: Tables):
    return quality.orphan_offer(t.events, t.offers)


@analysis("dq_orphan_person", """
SELECT e.* FROM ev e ANTI JOIN profile p ON p.id = e.person""")
def orphan_person(t: Tables):
    return quality.orphan_person(t.events, t.profile)


@analysis("dq_informational_completed", """
SELECT person, offer_id, event, reward, time, 'informational' AS offer_type FROM offer_completed
WHERE offer_id IN (SELECT id FROM portfolio_cleaned WHERE offer_type = 'informational')""")
def informational_completed(t: Tables):
    return quality.informational_completed(t.events, t.offers)


@analysis("dq_reward_mismatch", """
SELECT person, offer_id, event, reward, time, of_offer[offer_id] AS offer_reward
FROM offer_completed, (SELECT map(list(id), list(reward)) AS of_offer FROM portfolio_cleaned)
WHERE reward <> of_offer[offer_id]""")
def reward_mismatch(t: Tables):
    return quality.reward_mismatch(t.events, t.offers)


@analysis("dq_completed_without_receipt", f"""
SELECT c.offer_id, c.person
FROM ({oracle.in_force('SELECT person, offer_id, time FROM offer_completed', 'time', kind='LEFT')}) c
JOIN portfolio_cleaned p ON p.id = c.offer_id
WHERE coalesce(c.time > c.got + 24 * p.duration, true)""")
def completed_without_receipt(t: Tables):
    return quality.completed_without_receipt(t.events, t.offers, t.lifecycle_with("n_completed_rows"))


@analysis("dq_completed_after_expiry", f"""
SELECT person, offer_id, completed_time, received_time, expiry_time
FROM ({oracle.held_completions()}) WHERE completed_time > expiry_time""")
def completed_after_expiry(t: Tables):
    return quality.completed_after_expiry(t.events, t.offers, t.lifecycle)


@analysis("dq_completed_after_expiry_ctx", f"""
SELECT c.person, c.offer_id, CASE WHEN p.id IS NOT NULL THEN c.got END AS last_received_time,
       c.got + 24 * p.duration AS last_expiry_time, c.completed_time
FROM ({oracle.in_force(oracle.completions(), 'completed_time', kind='LEFT')}) c LEFT JOIN portfolio p ON p.id = c.offer_id
WHERE coalesce(c.completed_time > c.got + 24 * p.duration, true)""")
def completed_after_expiry_ctx(t: Tables):
    return quality.completed_after_expiry_context(t.events, t.offers, t.lifecycle)


@analysis("dq_completed_unviewed", """
SELECT person, offer_id, unnest(list_filter(got, lambda g: g <= c.time)) AS received_time, c.time AS completed_time
FROM offer_completed c
LEFT JOIN (SELECT person, offer_id, min(time) AS first_view FROM offer_viewed GROUP BY ALL) v USING (person, offer_id)
JOIN (SELECT person, offer_id, list(time) AS got FROM offer_received GROUP BY ALL) r USING (person, offer_id)
WHERE coalesce(first_view > c.time, true)""")
def completed_unviewed(t: Tables):
    return quality.completed_unviewed_pairs(t.events, t.lifecycle_with("n_received_rows", "n_completed_rows"))


@analysis("dq_completed_unviewed_alt", """
SELECT person, offer_id, time AS completed_time
FROM offer_completed LEFT JOIN (SELECT person, offer_id, min(time) AS first_view FROM offer_viewed GROUP BY ALL) USING (person, offer_id)
WHERE coalesce(first_view > time, true)""")
def completed_unviewed_alt(t: Tables):
    return quality.completed_unviewed(t.events, t.lifecycle_with("n_completed_rows"))


@analysis("dq_underspend_max", oracle.short_of(
    "completed_time", f"ROUND({oracle.known('n_rewards')}, 2)",
    "person, offer_id, received_time, completed_time, difficulty, total AS total_spent"))
def underspend_max(t: Tables):
    return quality.underspend_max(t.events, t.offers, t.lifecycle_with("reward_groups"))


@analysis("dq_underspend_rownum", oracle.short_of(
    "completed_time", f"ROUND({oracle.known()}, 0)",
    "person, offer_id, received_time, completed_time, difficulty, total AS total_spent"))
def underspend_rownum(t: Tables):
    return quality.underspend_rownum(t.events, t.offers, t.lifecycle)


@analysis("dq_underspend_window", oracle.short_of(
    "expiry_time", "CAST(spent * n_rows AS DOUBLE)",
    "person, offer_id, received_time, expiry_time, difficulty, completed_time, total AS total_spend, difficulty - total AS shortfall",
    where="completed_time <= expiry_time") + " ORDER BY person, offer_id, received_time")
def underspend_window(t: Tables):
    return quality.underspend_window(t.events, t.offers, t.lifecycle_with("n_completed_rows"))


@analysis("dq_overlapping_receipts", f"""
SELECT person, offer_id, time AS first_received, end_time AS first_end,
       unnest(list_filter(later, lambda t: t < end_time)) AS overlapping_received
FROM ({oracle.windows()}) ORDER BY person, offer_id, first_received""")
def overlapping_receipts(t: Tables):
    return quality.overlapping_receipts(t.events, t.offers, t.lifecycle)


@analysis("dq_overlapping_receipts_alt", f"""
SELECT person, offer_id, time AS first_received,
       unnest(list_filter(later, lambda t: t < expiry_time AND coalesce(t < next_done, true))) AS second_received,
       expiry_time, next_done AS completed_time
FROM ({oracle.windows()})""")
def overlapping_receipts_alt(t: Tables):
    return quality.overlapping_receipts_alt(t.events, t.offers, t.lifecycle)


# ---------------------------------------------------------------- previews
# ``TOP 5`` without ORDER BY is any five rows; here the first by all columns.

_PREVIEWS = {
    "dq_preview_profile": ("profile", lambda t: t.profile),
    "dq_preview_offers": ("portfolio_cleaned", lambda t: t.offers),
    "dq_preview_events": ("ev", lambda t: t.events),
    "dq_preview_offer_received": ("offer_received", lambda t: t.received),
    "dq_preview_offer_viewed": ("offer_viewed", lambda t: t.viewed),
    "dq_preview_transaction_done": ("transaction_done", lambda t: t.txns),
    "dq_preview_offer_completed": ("offer_completed", lambda t: t.completed),
}
for _name, (_relation, _src) in _PREVIEWS.items():
    analysis(_name, f"SELECT * FROM {_relation} ORDER BY ALL NULLS FIRST LIMIT 5")(lambda t, _s=_src: tables.preview(_s(t)))
