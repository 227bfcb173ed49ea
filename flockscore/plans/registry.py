"""Which indicators exist and which of them each scoring profile uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame

from flockscore import operators as op


@dataclass(frozen=True)
class Inputs:
    """Frames of one scoring run.

    ``other_status`` / ``other_users`` are the second dataset (the live stream
    next to the fetched history); indicators that look at both remove copies.
    """

    status: DataFrame
    users: DataFrame
    as_of: datetime
    source_q: DataFrame | None = None
    other_status: DataFrame | None = None
    other_users: DataFrame | None = None

    @property
    def statuses(self) -> list[DataFrame]:
        both = [self.status, self.other_status]
        return [status for status in both if status is not None]

    @property
    def datasets(self) -> list[tuple[DataFrame, DataFrame]]:
        pairs = [(self.status, self.users)]
        if self.other_status is not None:
            pairs.append((self.other_status, self.other_users))
        return pairs


@dataclass(frozen=True)
class Indicator:
    """``build`` returns rows (kpiname, userid, botscore).

    ``absent`` is the score of an account without any rows to look at where a
    profile scores single accounts; None leaves the indicator out for them.
    ``many`` marks indicators with several rows per account.
    """

    build: Callable[[Inputs], DataFrame]
    absent: float | None = None
    many: bool = False


INDICATORS: dict[str, Indicator] = {}


def register(name: str, indicator: Indicator) -> None:
    """Add an indicator; profiles refer to it by name."""
    INDICATORS[name] = indicator


@dataclass(frozen=True)
class Profile:
    """How indicators become one score.

    ``nulls``: a missing indicator counts as zero (``zero``), adds nothing but
    keeps its weight (``keep``), or is left out with its weight (``drop``).
    """

    weights: dict[str, float]
    nulls: str
    knockouts: tuple[str, ...] = ()
    single: bool = False
    renamed: dict[str, str] = field(default_factory=dict)

    def indicator(self, name: str) -> Indicator:
        return INDICATORS[self.renamed.get(name, name)]


register(
    "PROFILEAGE", Indicator(lambda i: op.kpi_profileage(i.users, as_of=i.as_of))
)
register("NAMDESCLEN", Indicator(lambda i: op.kpi_namdesclen(i.users), absent=1.0))
register("ANZFOLLOW", Indicator(lambda i: op.kpi_anzfollow(i.users), absent=0.0))
register(
    "TWEETMENTION", Indicator(lambda i: op.kpi_tweetmention(i.status), absent=1.0)
)
register("DECILPOSTS", Indicator(lambda i: op.kpi_decilposts(i.status), many=True))
register(
    "LANGUSERTWEETS", Indicator(lambda i: op.kpi_langusertweets(i.status, i.users))
)
register("TWEETFREQ", Indicator(lambda i: op.kpi_tweetfreq(*i.statuses), absent=0.0))
register(
    "STATUSFREQUENCY",
    Indicator(lambda i: op.kpi_statusfrequency(*i.datasets), absent=0.0),
)
register(
    "REACTIONTIME", Indicator(lambda i: op.kpi_reactiontime(*i.datasets), absent=0.0)
)
register("TWEETLANGS", Indicator(lambda i: op.kpi_tweetlangs(*i.statuses), absent=0.0))
register("TWEETCOUNT", Indicator(lambda i: op.kpi_tweetcount(*i.statuses), absent=0.0))
register(
    "SOURCEQUALIFICATION",
    Indicator(lambda i: op.kpi_sourcequalification(i.status, i.source_q)),
)
register(
    "KOSOURCEQUALIFICATION",
    Indicator(
        lambda i: op.kpi_ko_source(i.status, i.source_q).withColumnRenamed(
            "kobotscore", "botscore"
        ),
        absent=0.0,
    ),
)
# variants of the profile that scores single accounts
register(
    "REACTIONTIME_SELF",
    Indicator(
        lambda i: op.kpi_reactiontime(*i.datasets, self_only=True), absent=0.0
    ),
)
register(
    "TWEETLANGS_OWN",
    Indicator(
        lambda i: op.kpi_tweetlangs(*i.statuses, drop_retweets=True), absent=0.0
    ),
)

# what scoring may take from a shared pass; a replaced indicator is built alone
STANDARD = dict(INDICATORS)

# The indicators of each profile, all of weight 1.
STAGE1_KPIS = (
    "PROFILEAGE",
    "NAMDESCLEN",
    "ANZFOLLOW",
    "TWEETMENTION",
    "DECILPOSTS",
    "LANGUSERTWEETS",
    "TWEETFREQ",
)
STAGE2_KPIS = (
    "STATUSFREQUENCY",
    "REACTIONTIME",
    "TWEETLANGS",
    "TWEETFREQ",
    "TWEETCOUNT",
)
BATCH_KPIS = (
    *STAGE1_KPIS,
    "STATUSFREQUENCY",
    "REACTIONTIME",
    "TWEETLANGS",
    "TWEETCOUNT",
    "SOURCEQUALIFICATION",
)
KNOCKOUTS = ("KOSOURCEQUALIFICATION",)

STAGE1 = Profile(dict.fromkeys(STAGE1_KPIS, 1.0), nulls="zero")
STAGE2 = Profile(dict.fromkeys(STAGE2_KPIS, 1.0), nulls="zero")
BATCH = Profile(dict.fromkeys(BATCH_KPIS, 1.0), nulls="keep", knockouts=KNOCKOUTS)
PERUSER = Profile(
    {name: 1.0 for name in BATCH_KPIS if name != "DECILPOSTS"},
    nulls="drop",
    knockouts=KNOCKOUTS,
    single=True,
    renamed={"REACTIONTIME": "REACTIONTIME_SELF", "TWEETLANGS": "TWEETLANGS_OWN"},
)
