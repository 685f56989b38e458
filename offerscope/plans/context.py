"""The derived relations every analysis starts from.

``Tables`` wraps the three raw inputs and derives, lazily and once per
object, the relations the analyses use: flattened events, the de-duplicated
log, the per-type event views, the one-hot offer table and the cleaned
profile.  Nothing here runs a job.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import lifecycle as lc
from ..operators import prepare
from ..sources import fixtures


class Tables:
    def __init__(self, portfolio: DataFrame, profile: DataFrame, transcript: DataFrame):
        self.portfolio = portfolio
        self.profile = profile
        self.transcript = transcript
        # Build the as-of frame from the raw log (saves the de-duplication
        # shuffle) unless the de-duplicated log is already materialized.
        self.lifecycle_from_deduplicated = False

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        raw = fixtures.raw_tables(spark, sf_dir)
        return cls(raw.portfolio, raw.profile, raw.transcript)

    def materialized(self, parts=("flat", "events", "profile_clean")) -> "Tables":
        """A copy whose shared intermediates are computed once and written to
        the checkpoint folder: every analysis run on the copy reads them back
        instead of re-parsing and re-de-duplicating the log (and a lost
        executor re-reads files instead of replaying the lineage)."""
        from ..session import materialize
        out = Tables(self.portfolio, self.profile, self.transcript)
        for name in parts:
            out.__dict__[name] = materialize(getattr(out, name), name.replace("_", "-"))
        out.lifecycle_from_deduplicated = "events" in parts
        return out

    def after_cleaning(self) -> "Tables":
        """A copy whose event log is the log after the ordered deletes
        (``cleaning.clean_events``), as the descriptive analyses saw it when
        they ran after the cleaning script."""
        from .cleaning import clean_events
        out = Tables(self.portfolio, self.profile, self.transcript)
        out.__dict__["events"] = clean_events(self.events, self.offers)
        out.lifecycle_from_deduplicated = True
        return out

    # ---- offers --------------------------------------------------------
    @cached_property
    def offers(self) -> DataFrame:
        """``portfolio_cleaned``: offer attributes with 0/1 channel flags."""
        return prepare.onehot_channels(self.portfolio)

    # ---- events --------------------------------------------------------
    @cached_property
    def flat(self) -> DataFrame:
        """Flattened, typed log before de-duplication (the audit's view)."""
        return prepare.flatten_events(self.transcript)

    @cached_property
    def events(self) -> DataFrame:
        """The log with exact repeats removed: input of every later analysis."""
        return prepare.dedupe_events(self.flat)

    @cached_property
    def received(self) -> DataFrame:
        return prepare.received(self.events)

    @cached_property
    def viewed(self) -> DataFrame:
        return prepare.viewed(self.events)

    @cached_property
    def txns(self) -> DataFrame:
        return prepare.transactions(self.events)

    @cached_property
    def completed(self) -> DataFrame:
        return prepare.completed(self.events)

    def lifecycle_with(self, *counts: str) -> DataFrame:
        """As-of frame with the asked ``counts`` of ``lifecycle.event_keys``.
        Insensitive to exact repeats, so it is built from the raw flattened
        log unless the de-duplicated log is materialized."""
        if self.lifecycle_from_deduplicated:
            return lc.lifecycle(self.events, deduplicated=True, counts=counts)
        return lc.lifecycle(self.flat, counts=counts)

    @cached_property
    def lifecycle(self) -> DataFrame:
        return self.lifecycle_with()

    # ---- profiles ------------------------------------------------------
    @cached_property
    def profile_dated(self) -> DataFrame:
        return prepare.profile_with_date(self.profile)

    @cached_property
    def profile_clean(self) -> DataFrame:
        from .cleaning import clean_profile
        return clean_profile(self.profile)
