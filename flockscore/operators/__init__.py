"""Indicators: each maps frames to rows (kpiname, userid, botscore, details)."""

from flockscore.operators.activity import (
    kpi_decilposts,
    kpi_statusfrequency,
    kpi_tweetcount,
    kpi_tweetfreq,
    kpi_tweetmention,
)
from flockscore.operators.language import kpi_langusertweets, kpi_tweetlangs
from flockscore.operators.positions import fetch_positions, init_positions
from flockscore.operators.profile import (
    kpi_anzfollow,
    kpi_namdesclen,
    kpi_profileage,
)
from flockscore.operators.reaction import kpi_reactiontime
from flockscore.operators.source import kpi_ko_source, kpi_sourcequalification

__all__ = [
    "fetch_positions",
    "init_positions",
    "kpi_anzfollow",
    "kpi_decilposts",
    "kpi_ko_source",
    "kpi_langusertweets",
    "kpi_namdesclen",
    "kpi_profileage",
    "kpi_reactiontime",
    "kpi_sourcequalification",
    "kpi_statusfrequency",
    "kpi_tweetcount",
    "kpi_tweetfreq",
    "kpi_tweetlangs",
    "kpi_tweetmention",
]
