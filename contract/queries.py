"""All registered queries, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import fixtures as fx
from contract import oracles as sql
from flockscore import operators as op
from flockscore.plans import reports, rollups, texts
from flockscore.plans import score as sc
from flockscore.plans.registry import BATCH, PERUSER, Indicator, register
from flockscore.plans.sqlfunctions import register_functions
from flockscore.schemas import CHALLENGE, SESSION
from flockscore.session import materialise, run_dir
from flockscore.sources import normalise as norm
from flockscore.sources import tables, versioned
from flockscore.sources.bucketed import store_pair
from flockscore.sources.sessions import open_session
from flockscore.sources.tweets import admit
from flockscore.streaming import ingest, rescore, rolling
from flockscore.streaming.commits import folders, remove

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WORDS = ("der", "die", "und", "les", "des", "and", "was")
FOLLOW = [1, 2, 3, 5, 8, 13]
TRACK = ["the", "der die", "#gameinsight", "les des"]


def digits(column: str) -> int | None:
    """Places compared where the order of additions can show; else all."""
    if "score" in column:
        return 9
    return 7 if column == "profileage" else None


def tidy(df: DataFrame) -> DataFrame:
    """Scores rounded and whole numbers as bigint, for the comparison."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "double" and digits(name):
            column = F.round(column, digits(name))
        elif kind in ("int", "smallint"):
            column = column.cast("bigint")
        columns.append(column.alias(name))
    return df.select(columns)


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its SQL without the shared parts."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(build(spark, sf))
        if oracle is not None:
            ORACLES[name] = sql.with_ctes(oracle)
        return build

    return add


def rounded(source: str, doubles: str, others: str) -> str:
    """SQL that selects columns of ``source`` the way ``tidy`` does."""
    columns = [f"cast({c} as bigint) as {c}" for c in others.split()]
    for name in doubles.split():
        number = f"cast({name} as double)"
        if digits(name):
            number = f"round({number}, {digits(name)})"
        columns.append(f"{number} as {name}")
    return "select " + ", ".join(columns) + f" from {source}"


def kpi(source: str, doubles: str = "botscore", others: str = "userid") -> str:
    inner = rounded(source, doubles, others)
    return inner.replace("select ", "select kpiname, ", 1)


def _bots(spark: SparkSession, sf: str, name: str, totals: Query) -> DataFrame:
    """The bot list as a written table, as the reports want it."""
    found = sc.bots(totals(spark, sf)).select("userid")
    return materialise(found, run_dir(spark, name))


def _stage1_total(spark: SparkSession, sf: str) -> DataFrame:
    return sc.weighted_total(sc.stage1_table(fx.live(spark, sf)))


def _stage2_total(spark: SparkSession, sf: str) -> DataFrame:
    history = fx.history(spark, sf)
    common = sc.common_table(sc.stage1_table(fx.live(spark, sf)), history)
    return sc.two_stage_total(sc.stage2_table(fx.both(spark, sf)), common)


@fx.once
def stage1_bots(spark: SparkSession, sf: str) -> DataFrame:
    return _bots(spark, sf, "bots1", _stage1_total)


@fx.once
def stage2_bots(spark: SparkSession, sf: str) -> DataFrame:
    return _bots(spark, sf, "bots2", _stage2_total)


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return sc.challenge_accounts(fx.challenge(spark, sf))


# ------------------------------------------------------------ indicators


@query("kpi_profileage", kpi("k_profileage", "botscore profileage"))
def _(spark, sf):
    return op.kpi_profileage(fx.users(spark, sf), as_of=fx.AS_OF)


@query("kpi_namdesclen", kpi("k_namdesclen", "botscore profilenamelen desclen"))
def _(spark, sf):
    return op.kpi_namdesclen(fx.users(spark, sf))


@query(
    "kpi_anzfollow",
    kpi("k_anzfollow", "botscore anzfollower anzfriends ratiofolfriend"),
)
def _(spark, sf):
    return op.kpi_anzfollow(fx.users(spark, sf))


@query(
    "kpi_tweetmention",
    kpi("k_tweetmention", "botscore umprotweet", "userid anzahltweets"),
)
def _(spark, sf):
    return op.kpi_tweetmention(fx.posts(spark, sf))


@query(
    "kpi_decilposts", kpi("k_decilposts", "botscore", "userid sessionid anz decil")
)
def _(spark, sf):
    return op.kpi_decilposts(fx.posts(spark, sf))


@query("kpi_langusertweets", kpi("k_langusertweets"))
def _(spark, sf):
    return op.kpi_langusertweets(fx.posts(spark, sf), fx.users(spark, sf))


@query("kpi_tweetfreq", kpi("k_tweetfreq", "botscore mingap"))
def _(spark, sf):
    return op.kpi_tweetfreq(fx.posts(spark, sf))


@query("kpi_tweetfreq_600s", kpi(f"({sql.tweetfreq(600)})", "botscore mingap"))
def _(spark, sf):
    return op.kpi_tweetfreq(fx.posts(spark, sf), seconds=600)


@query("kpi_tweetfreq_both", kpi("b_tweetfreq", "botscore mingap"))
def _(spark, sf):
    return op.kpi_tweetfreq(*fx.both(spark, sf).statuses)


HOURS = " ".join(f"uhr{h}" for h in range(24))


@query("kpi_statusfrequency", kpi("k_statusfrequency", "botscore", f"userid {HOURS}"))
def _(spark, sf):
    return op.kpi_statusfrequency((fx.posts(spark, sf), fx.users(spark, sf)))


@query(
    "kpi_statusfrequency_both",
    kpi("b_statusfrequency", "botscore", f"userid {HOURS}"),
)
def _(spark, sf):
    return op.kpi_statusfrequency(*fx.both(spark, sf).datasets)


GAPS = "botscore minawz mittelawz maxawzeit"


@query("kpi_reactiontime", kpi("k_reactiontime", GAPS, "userid anzawzeit"))
def _(spark, sf):
    return op.kpi_reactiontime((fx.posts(spark, sf), fx.users(spark, sf)))


@query("kpi_reactiontime_both", kpi("b_reactiontime", GAPS, "userid anzawzeit"))
def _(spark, sf):
    return op.kpi_reactiontime(*fx.both(spark, sf).datasets)


@fx.once
def _bucketed(spark, sf):
    return store_pair(fx.history(spark, sf).drop("status_text"), fx.history_users(spark, sf), run_dir(spark, "bucketed"))


@query("kpi_langusertweets_bucketed", kpi("h_langusertweets"))
def _(spark, sf):
    return op.kpi_langusertweets(*_bucketed(spark, sf))


@query("kpi_statusfrequency_bucketed", kpi("h_statusfrequency", "botscore", f"userid {HOURS}"))
def _(spark, sf):
    return op.kpi_statusfrequency(_bucketed(spark, sf))


@query("kpi_tweetlangs", kpi("k_tweetlangs", "botscore", "userid anzlang anztweets"))
def _(spark, sf):
    return op.kpi_tweetlangs(fx.posts(spark, sf))


@query(
    "kpi_tweetlangs_both", kpi("b_tweetlangs", "botscore", "userid anzlang anztweets")
)
def _(spark, sf):
    return op.kpi_tweetlangs(*fx.both(spark, sf).statuses)


@query("kpi_tweetcount", kpi("k_tweetcount"))
def _(spark, sf):
    return op.kpi_tweetcount(fx.posts(spark, sf))


@query("kpi_tweetcount_5", kpi(f"({sql.tweetcount(5)})"))
def _(spark, sf):
    return op.kpi_tweetcount(fx.posts(spark, sf), per_day=5)


@query("kpi_tweetcount_both", kpi("b_tweetcount"))
def _(spark, sf):
    return op.kpi_tweetcount(*fx.both(spark, sf).statuses)


@query("kpi_tweetcount_both_5", kpi(f"({sql.tweetcount(5, both=True)})"))
def _(spark, sf):
    return op.kpi_tweetcount(*fx.both(spark, sf).statuses, per_day=5)


@query(
    "kpi_tweetfreq_both_600s",
    kpi(f"({sql.tweetfreq(600, both=True)})", "botscore mingap"),
)
def _(spark, sf):
    return op.kpi_tweetfreq(*fx.both(spark, sf).statuses, seconds=600)


@query(
    "kpi_reactiontime_self",
    kpi("k_reactiontime_self", GAPS, "userid anzawzeit"),
)
def _(spark, sf):
    inputs = (fx.posts(spark, sf), fx.users(spark, sf))
    return op.kpi_reactiontime(inputs, self_only=True)


@query("kpi_sourcequalification", kpi("k_sourcequalification"))
def _(spark, sf):
    return op.kpi_sourcequalification(fx.posts(spark, sf), fx.source_q(spark))


@query("kpi_ko_source", kpi("k_ko_source", "kobotscore"))
def _(spark, sf):
    return op.kpi_ko_source(fx.posts(spark, sf), fx.source_q(spark))


def _single(name: str) -> None:
    """One indicator as scored for single accounts, over all listed ones."""
    source = f"(select * from single where kpiname = '{name}')"

    @query(f"kpi_{name.lower()}_peruser", kpi(source))
    def _(spark, sf):
        rows = sc.kpi_rows(fx.fetched(spark, sf), PERUSER, [name])
        table = sc.kpi_table(rows, _listed(spark, sf), PERUSER)
        return table.where(F.col("kpiname") == name).drop("weight")


for _name in ("TWEETMENTION", "TWEETFREQ", "REACTIONTIME", "TWEETLANGS"):
    _single(_name)


# ----------------------------------------------------------- composition

WEIGHTED = "botscore weight"


@query("stage1_kpidata", kpi("stage1", WEIGHTED))
def _(spark, sf):
    return sc.stage1_table(fx.live(spark, sf))


@query("stage1_scores", rounded("stage1_total", "totalbotscore", "userid"))
def _(spark, sf):
    return _stage1_total(spark, sf)


@query(
    "stage1_botlist",
    rounded("stage1_total where totalbotscore > 0.5", "totalbotscore", "userid"),
)
def _(spark, sf):
    return sc.bots(_stage1_total(spark, sf))


@query("stage2_kpidata", kpi("stage2", WEIGHTED))
def _(spark, sf):
    return sc.stage2_table(fx.both(spark, sf))


@query("stage2_common", rounded("common", WEIGHTED, "userid"))
def _(spark, sf):
    return sc.common_table(
        sc.stage1_table(fx.live(spark, sf)), fx.history(spark, sf)
    )


@query("stage2_scores", rounded("stage2_total", "totalbotscore", "userid"))
def _(spark, sf):
    return _stage2_total(spark, sf)


@query(
    "stage2_botlist",
    rounded("stage2_total where totalbotscore > 0.5", "totalbotscore", "userid"),
)
def _(spark, sf):
    return sc.bots(_stage2_total(spark, sf))


def _batch_table(spark, sf):
    rows = sc.kpi_rows(fx.fetched(spark, sf), BATCH)
    return sc.kpi_table(rows, _listed(spark, sf), BATCH)


def _batch_ko(spark, sf):
    rows = sc.kpi_rows(fx.fetched(spark, sf), BATCH, list(BATCH.knockouts))
    return sc.ko_table(rows, _listed(spark, sf), BATCH)


@query("batch_kpidata", kpi("batch", WEIGHTED))
def _(spark, sf):
    return _batch_table(spark, sf)


@query("batch_botlist", rounded("batch_total", "totalbotscore", "userid"))
def _(spark, sf):
    return sc.by_score(sc.weighted_total(_batch_table(spark, sf)), "totalbotscore")


@query("batch_kokpidata", kpi("ko", "kobotscore"))
def _(spark, sf):
    return _batch_ko(spark, sf)


@query("batch_ko", rounded("ko_total", "totalkobotscore", "userid"))
def _(spark, sf):
    return sc.by_score(sc.ko_total(_batch_ko(spark, sf)), "totalkobotscore")


@query("batch_integrated", rounded("integrated", "totalscore", "userid"))
def _(spark, sf):
    total = sc.weighted_total(_batch_table(spark, sf))
    ko = sc.ko_total(_batch_ko(spark, sf))
    return sc.by_score(sc.integrate(total, ko), "totalscore")


EXPORT = """
    select c.user_id, c.parent_screen_name, c.parent_id,
           round(i.totalscore, 9) as botscore
    from challenge c left join integrated i on i.userid = c.user_id"""


@query("batch_export", EXPORT)
def batch_export(spark, sf):
    listed = fx.challenge(spark, sf)
    scores = sc.score(fx.fetched(spark, sf), _listed(spark, sf), BATCH)
    return sc.export(listed, scores)


@query("peruser_total", rounded("single_total", "totalbotscore", "userid"))
def _(spark, sf):
    rows = sc.kpi_rows(fx.fetched(spark, sf), PERUSER)
    return sc.weighted_total(sc.kpi_table(rows, _listed(spark, sf), PERUSER))


@query("peruser_score", rounded("single_score", "totalscore", "userid"))
def _(spark, sf):
    return sc.score(fx.fetched(spark, sf), _listed(spark, sf), PERUSER)


@query(
    "score_one_account",
    rounded("single_score where userid = 7", "totalscore", "userid"),
)
def _(spark, sf):
    one = _listed(spark, sf).where("userid = 7")
    return sc.score(sc.of_account(fx.fetched(spark, sf), 7), one, PERUSER)


@query(
    "registered_knockout",
    """select userid, round(greatest(totalscore, coalesce(ko, 0)), 9) as totalscore
       from integrated left join (
           select status_user_id as userid, if(avg(isretweet) > 0.1, 1.0, 0.0) as ko
           from history group by 1) using (userid)""",
)
def _(spark, sf):
    """A further knock-out that a user registers: more than a tenth retweets."""

    def build(inputs):
        share = inputs.status.groupBy(F.col("status_user_id").alias("userid")).agg(
            F.avg("isretweet").alias("share")
        )
        flag = F.when(F.col("share") > 0.1, 1.0).otherwise(0.0)
        return share.select(F.lit("KORETWEETS").alias("kpiname"), "userid", flag.alias("botscore"))

    register("KORETWEETS", Indicator(build))
    profile = replace(BATCH, knockouts=(*BATCH.knockouts, "KORETWEETS"))
    return sc.score(fx.fetched(spark, sf), _listed(spark, sf), profile)


@query(
    "sql_functions",
    """select kpiname, userid, round(botscore, 9) as botscore from h_tweetcount where userid = 7
       union all
       select kpiname, userid, round(botscore, 9) from h_langusertweets where userid = 7
       union all
       select 'SCORE', userid, round(totalscore, 9) from single_score where userid = 7""",
)
def _(spark, sf):
    register_functions(fx.fetched(spark, sf), _listed(spark, sf))
    return spark.sql(
        """select * from kpi_tweetcount(7)
           union all select * from kpi_langusertweets(7)
           union all select 'SCORE', userid, totalscore from kpi_score(7)"""
    )


WRITE_BACK = """
    select c.user_id, c.parent_screen_name, c.parent_id,
           round(if(s.userid is null, c.botscore, s.totalscore), 9) as botscore,
           c.maxtweetid
    from challenge c left join (
        select userid, totalscore from single_score
        where userid in (select status_user_id from history)) s
        on s.userid = c.user_id"""


@query("peruser_write_back", WRITE_BACK)
def _(spark, sf):
    inputs = fx.fetched(spark, sf)
    scores = sc.score(inputs, sc.accounts_of(inputs.status), PERUSER)
    return sc.write_back(fx.challenge(spark, sf), scores)


@query("peruser_write_back_stored", WRITE_BACK)
def _(spark, sf):
    """As ``peruser_write_back``, in the stored table."""
    path = run_dir(spark, "listed")
    versioned.create_table(fx.challenge(spark, sf), path)
    inputs = fx.fetched(spark, sf)
    versioned.write_back_stored(spark, path, sc.score(inputs, sc.accounts_of(inputs.status), PERUSER))
    return versioned.read_table(spark, path)


NEWEST = "select status_user_id as userid, max(id) as newest from {} group by 1"
POSITIONS = """
    select coalesce(u.userid, n.userid) as userid,
           coalesce(n.newest, 1) as tweetid
    from ({universe}) u full join ({newest}) n on n.userid = u.userid"""


@query(
    "positions_candidates",
    POSITIONS.format(
        universe="select userid from bots1", newest=NEWEST.format("history")
    ),
)
def _(spark, sf):
    found = sc.bots(_stage1_total(spark, sf))
    return op.fetch_positions(found, fx.history(spark, sf))


@query(
    "positions_challenge",
    POSITIONS.format(universe=sql.LISTED, newest=NEWEST.format("posts")),
)
def _(spark, sf):
    return op.fetch_positions(_listed(spark, sf), fx.posts(spark, sf))


@query(
    "init_positions",
    f"""select c.* replace (coalesce(n.newest, 1) as maxtweetid,
                            round(c.botscore, 9) as botscore)
        from challenge c left join ({NEWEST.format("posts")}) n
             on n.userid = c.user_id""",
)
def _(spark, sf):
    return op.init_positions(fx.challenge(spark, sf), fx.posts(spark, sf))


# --------------------------------------------------------------- reports

PER_TOPIC = """
    select s.track_topics, count(distinct p.status_user_id) as useranzahl,
           count(distinct b.userid) as botanzahl
    from posts p left join bots2 b on b.userid = p.status_user_id
    left join session s on s.id = p.session_id
    group by s.track_topics"""
PER_DAY = """
    select s.track_topics, date_trunc('day', p.created_at) as tweetdatum,
           count(distinct p.status_user_id) as useranzahl,
           count(distinct p.id) as tweetanzahl,
           count(distinct p.id) filter (b.userid is not null) as bottweetanzahl
    from posts p left join bots2 b on b.userid = p.status_user_id
    left join session s on s.id = p.session_id
    group by 1, 2"""


def _per_topic(spark, sf):
    return reports.bots_per_topic(
        fx.posts(spark, sf), stage2_bots(spark, sf), fx.session(spark)
    )


def _per_day(spark, sf):
    return reports.counts_per_day(
        fx.posts(spark, sf), stage2_bots(spark, sf), fx.session(spark)
    )


@query("bots_per_topic", PER_TOPIC)
def _(spark, sf):
    return _per_topic(spark, sf)


@query(
    "counts_per_day",
    f"select * replace (cast(tweetdatum as timestamp) as tweetdatum) from ({PER_DAY})",
)
def _(spark, sf):
    return _per_day(spark, sf)


@query(
    "topic_long",
    f"""unpivot (select * replace (replace(track_topics, ',', chr(10))
                                   as track_topics) from ({PER_TOPIC}))
        on useranzahl, botanzahl into name variable value value""",
)
def _(spark, sf):
    report = reports.topic_label(_per_topic(spark, sf))
    return reports.long_form(report, ["track_topics"])


@query(
    "day_long",
    f"""unpivot (select cast(tweetdatum as timestamp) as tweetdatum, tweetanzahl,
                        bottweetanzahl
                 from ({PER_DAY}) where track_topics = '#a')
        on tweetanzahl, bottweetanzahl into name variable value value""",
)
def _(spark, sf):
    report = _per_day(spark, sf).where(F.col("track_topics") == "#a")
    return reports.long_form(
        report.drop("track_topics", "useranzahl"), ["tweetdatum"]
    )


@query(
    "top_urls",
    """select url, count(distinct userid) as urlanz
       from (select * from links union all select * from old_links)
       where userid in (select userid from bots2) and url is not null
       group by url order by urlanz desc, url limit 30""",
)
def _(spark, sf):
    linked = fx.posts_with_urls(spark, sf).select("status_user_id", "urls")
    older = fx.old_entities(spark, sf).select("status_user_id", "urls")
    return reports.top_urls([linked, older], stage2_bots(spark, sf))


@query(
    "top_hashtags",
    """select tag as httext, count(distinct userid) as htanz
       from (select * from tags union all select * from old_tags)
       where userid in (select userid from bots2) and tag is not null
       group by tag order by htanz desc, tag limit 30""",
)
def _(spark, sf):
    tagged = fx.posts(spark, sf).select("status_user_id", "hashtags")
    older = fx.old_entities(spark, sf).select("status_user_id", "hashtags")
    return reports.top_hashtags([tagged, older], stage2_bots(spark, sf))


@query("topic_text", sql.text_parts("topic_posts", "track_topics, is_bot"))
def _(spark, sf):
    return texts.topic_text(
        fx.posts(spark, sf, spread=True), fx.session(spark), stage1_bots(spark, sf)
    )


@query("challenge_text", sql.text_parts("listed_posts", "is_bot"))
def _(spark, sf):
    posts = fx.posts(spark, sf, spread=True)
    return texts.challenge_text(posts, fx.challenge(spark, sf))


@query(
    "tagged_bot_posts",
    """select count(*) as anz from posts p
       join challenge c on c.user_id = p.status_user_id
       where c.botscore > 0.5 and p.status_text like '%gameinsight%'""",
)
def _(spark, sf):
    return texts.tagged_bot_posts(
        fx.posts(spark, sf), fx.challenge(spark, sf), tag="gameinsight"
    )


@query("term_frequencies", sql.TOPIC_TERMS)
def _(spark, sf):
    posts = texts.topic_posts(
        fx.posts(spark, sf, spread=True), fx.session(spark), stage1_bots(spark, sf)
    )
    return texts.term_frequencies(posts, stopwords=WORDS)


@query("term_frequencies_followers", sql.FOLLOWER_TERMS)
def _(spark, sf):
    posts = fx.posts(spark, sf, spread=True)
    posts = texts.challenge_posts(posts, fx.challenge(spark, sf))
    return texts.term_frequencies(
        posts,
        ["is_bot"],
        phrases=texts.FOLLOWER_PHRASES,
        stopwords=WORDS,
        own_stopwords=texts.FOLLOWER_STOPWORDS,
    )


STATS = """strftime(min({0}), '%d.%m.%Y') as startdatum,
           strftime(max({0}), '%d.%m.%Y') as enddatum,
           count(distinct p.id) as anztweets,
           count(distinct p.status_user_id) as anzuser"""


@query(
    "collection_stats",
    f"""select s.track_topics, {STATS.format("p.recorded_at")}
        from posts p join session s on s.id = p.session_id group by 1""",
)
def _(spark, sf):
    return reports.collection_stats(fx.posts(spark, sf), fx.session(spark))


@fx.once
def _rollup(spark, sf):
    """The stored table of the three reports below."""
    posts = fx.posts(spark, sf)
    numbers = rollups.number_accounts(sc.accounts_of(posts))
    found = rollups.daily_rollup(posts, fx.session(spark), stage2_bots(spark, sf), numbers)
    return materialise(found, run_dir(spark, "rollup"))


@query("rollup_topics", PER_TOPIC)
def _(spark, sf):
    return rollups.topics_of(_rollup(spark, sf))


@query(
    "rollup_days",
    f"select * replace (cast(tweetdatum as timestamp) as tweetdatum) from ({PER_DAY})",
)
def _(spark, sf):
    return rollups.days_of(_rollup(spark, sf))


@query(
    "rollup_stats",
    f"""select s.track_topics, {STATS.format("p.recorded_at")}
        from posts p join session s on s.id = p.session_id group by 1""",
)
def _(spark, sf):
    return rollups.stats_of(_rollup(spark, sf))


@query(
    "collection_stats_all",
    f"select 'all' as track_topics, {STATS.format('p.created_at')} from history p",
)
def _(spark, sf):
    return reports.collection_stats_all(fx.history(spark, sf), "all")


def histogram(source: str, column: str) -> str:
    return f"""
    select if({column} between 0 and 1,
              cast(greatest(ceil(round({column} * 100, 6)), 1) as bigint), null) as bin,
           case when {column} < 0 then 'below' when {column} > 1 then 'above'
                when {column} is null then 'unknown' else 'inside' end as place,
           if({column} > 0.5, 'Bot', 'Kein Bot') as botflag, count(*) as anz
    from {source} group by 1, 2, 3"""


@query("score_histogram", histogram("stage1_total", "totalbotscore"))
def _(spark, sf):
    return reports.score_histogram(_stage1_total(spark, sf), "totalbotscore")


@query("score_histogram_stage2", histogram("stage2_total", "totalbotscore"))
def _(spark, sf):
    return reports.score_histogram(_stage2_total(spark, sf), "totalbotscore")


@query("score_histogram_challenge", histogram("challenge", "botscore"))
def _(spark, sf):
    return reports.score_histogram(fx.challenge(spark, sf), "botscore")


@query(
    "validation_sample",
    """select distinct * from (
           select 'https://twitter.com/' || u.screen_name as userurl,
                  printf('%.2f', c.botscore) as botscore
           from challenge c left join users u on u.id = c.user_id
           where c.botscore is not null)
       order by md5('0|' || userurl || '|' || botscore) limit 100""",
)
def _(spark, sf):
    return reports.validation_sample(fx.challenge(spark, sf), fx.users(spark, sf))


@query(
    "unqualified_sources",
    """select status_source, count(*) as anz from history
       where status_source not in (select source from source_q) group by 1""",
)
def _(spark, sf):
    return reports.unqualified_sources(fx.history(spark, sf), fx.source_q(spark))


@query(
    "all_sources",
    """select sourceatt, count(*) as anz
       from (select status_source as sourceatt from posts
             union all select status_source from history) group by 1""",
)
def _(spark, sf):
    return reports.all_sources([fx.posts(spark, sf), fx.history(spark, sf)])


# ------------------------------------------------------ sources and sinks

_tokens = (
    "regexp_extract_all(lower(status_text), '[#@]?[\\p{L}\\p{N}_]+')"
)


def _has(*words: str) -> str:
    """SQL for: all of ``words`` occur, plain ones also as hashtag or mention."""
    tests = []
    for word in words:
        forms = [word] if word[0] in "#@" else [word, "#" + word, "@" + word]
        values = ", ".join(f"'{f}'" for f in forms)
        tests.append(f"list_has_any(tokens, [{values}])")
    return "(" + " and ".join(tests) + ")"


ADMITTED = f"""select id, status_user_id, lang
    from (select *, {_tokens} as tokens from posts)
    where (status_user_id in ({", ".join(map(str, FOLLOW))})
           or {" or ".join(_has(*phrase.split()) for phrase in TRACK)})"""


def _admitted(spark, sf, language=None):
    admitted = admit(
        fx.posts(spark, sf, spread=True),
        follow=FOLLOW,
        track=TRACK,
        language=language,
        author="status_user_id",
        text="status_text",
    )
    return admitted.select("id", "status_user_id", "lang")


@query("admission_filter", ADMITTED)
def _(spark, sf):
    return _admitted(spark, sf)


@query("admission_filter_language", f"{ADMITTED} and lang = 'fr'")
def _(spark, sf):
    return _admitted(spark, sf, "fr")


def _prepared(spark, sf):
    return norm.prepare(fx.tweets(spark, sf), 1, F.lit(fx.AS_OF))


@query(
    "normalise_status",
    """select id, date_trunc('second', created_at) as created_at,
              cast(1 as bigint) as session_id, status_user_id, lang, status_source,
              cast(if(isretweet = 1, id + 1, null) as bigint)
                  as retweeted_status_id,
              cast(isretweet as bigint) as isretweet,
              coalesce(reply_to, -1) as in_reply_to_status_id,
              cast(n_mentions as bigint) as n_mentions,
              status_source = 'signup' as has_place
       from posts""",
)
def _(spark, sf):
    return norm.statuses(_prepared(spark, sf)).select(
        "id",
        "created_at",
        "session_id",
        "status_user_id",
        "lang",
        "status_source",
        "retweeted_status_id",
        "isretweet",
        "in_reply_to_status_id",
        F.size("mentions").alias("n_mentions"),
        F.col("status_place_id").isNotNull().alias("has_place"),
    )


@query(
    "normalise_users",
    """select a.id, p.id as status_id, screen_name, description, a.created_at, a.lang,
              cast(followers_count as bigint) as followers_count,
              cast(friends_count as bigint) as friends_count,
              cast(coalesce(utcoffset, -1) as bigint) as utcoffset
       from accounts a join posts p on p.status_user_id = a.id""",
)
def _(spark, sf):
    return norm.user_snapshots(_prepared(spark, sf)).select(
        "id",
        "status_id",
        "screen_name",
        "description",
        "created_at",
        "lang",
        "followers_count",
        "friends_count",
        "utcoffset",
    )


@query(
    "normalise_urls",
    """select p.id as status_id, cast(0 as bigint) as pos, g.url, g.url as expanded_url,
              cast(0 as bigint) as indices_start, cast(1 as bigint) as indices_end
       from posts p, (select count(*) as size from pages) n
       join pages g on g.page_id = p.id % n.size
       where p.status_source in ('click', 'view')""",
)
def _(spark, sf):
    return norm.urls(_prepared(spark, sf)).where("kind = 'url'").select(
        "status_id", "pos", "url", "expanded_url", "indices_start", "indices_end"
    )


MEDIA = """select p.id as status_id, cast(m.pos as bigint) as pos, g.url
       from posts p, (select count(*) as size from pages) n, (values (0), (1)) m(pos)
       join pages g on g.page_id = p.id % n.size
       where p.id % 6 = 0 and m.pos <= p.id // 6 % 2"""
PROFILE_LINKS = """select p.id as status_id, 'user_url' as kind, cast(0 as bigint) as pos,
              'https://home/' || p.status_user_id as url
       from posts p join accounts a on a.id = p.status_user_id
       where p.status_user_id % 3 = 0
       union all
       select p.id, 'description_url', cast(m.pos as bigint),
              if(m.pos = 0, 'https://home/' || p.status_user_id, 'https://b')
       from posts p join accounts a on a.id = p.status_user_id, (values (0), (1)) m(pos)
       where p.status_user_id % 5 = 0"""


@query("normalise_media", f"select *, url as media_url, 'photo' as media_type from ({MEDIA})")
def _(spark, sf):
    return norm.media(_prepared(spark, sf)).select(
        "status_id", "pos", "url", "media_url", "media_type"
    )


@query("normalise_profile_links", PROFILE_LINKS)
def _(spark, sf):
    links = norm.urls(_prepared(spark, sf)).where("kind <> 'url'")
    return links.select("status_id", "kind", "pos", "url")


@query(
    "normalise_keys",
    f"""select 'media' as kind, status_id, pos, true as one_key from ({MEDIA})
        union all
        select 'mention', id, cast(0 as bigint), true from posts where n_mentions = 1
        union all
        select 'hashtag', id, cast(0 as bigint), true from posts
        union all
        select 'hashtag', id, cast(1 as bigint), true from posts where second_tag is not null
        union all
        select kind, status_id, pos, true from ({PROFILE_LINKS}) where kind = 'user_url'""",
)
def _(spark, sf):
    """Children found from their status, or its snapshot, by surrogate key alone, and
    whether each has a key of its own. The messages are taken apart once; no key
    depends on a text, so none is kept."""
    tweets = _prepared(spark, sf).withColumn("text", F.lit(None).cast("string"))
    tweets = materialise(tweets, run_dir(spark, "prepared"))
    owners = {
        "media": (norm.media(tweets), norm.statuses(tweets), "mediaentities_id", "id"),
        "mention": (norm.mentions(tweets), norm.statuses(tweets), "usermentionentities_id", "id"),
        "hashtag": (norm.hashtags(tweets), norm.statuses(tweets), "hashtagentities_id", "id"),
        "user_url": (
            norm.urls(tweets).where("kind = 'user_url'"),
            norm.user_snapshots(tweets),
            "urlentity_id",
            "status_id",
        ),
    }
    found = None
    for kind, (children, parents, key, of) in owners.items():
        own = parents.where(F.col(key).isNotNull()).select(
            F.col(key).alias("entity_id"), F.col(of).alias("status_id")
        )
        joined = children.select("entity_id", "id", "pos").join(own, "entity_id")
        once = joined.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        rows = joined.join(once, "id").select(
            F.lit(kind).alias("kind"), "status_id", "pos", (F.col("n") == 1).alias("one_key")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "normalise_hashtags",
    """select id as status_id, cast(0 as bigint) as pos, status_source as httext
       from posts
       union all
       select id, cast(1 as bigint), second_tag from posts
       where second_tag is not null""",
)
def _(spark, sf):
    return norm.hashtags(_prepared(spark, sf)).select("status_id", "pos", "httext")


@query(
    "normalise_mentions",
    """select id as status_id, cast(0 as bigint) as pos, status_user_id as user_id
       from posts where n_mentions = 1""",
)
def _(spark, sf):
    return norm.mentions(_prepared(spark, sf)).select("status_id", "pos", "user_id")


@query(
    "normalise_geolocations",
    """select id as status_id, cast(pos as bigint) as pos,
              cast(status_user_id % 90 as double) as latitude,
              cast(status_user_id % 180 as double) as longitude
       from posts, (values (0), (1)) c(pos) where status_source = 'signup'""",
)
def _(spark, sf):
    return norm.geolocations(_prepared(spark, sf)).select(
        "status_id", "pos", "latitude", "longitude"
    )


@query(
    "normalise_places",
    """select p.id as status_id, d.source as pname, 'Polygon' as bb_type
       from posts p, (select count(*) as size from documents) n
       join documents d on d.doc_id = p.id % n.size
       where p.status_source = 'signup'""",
)
def _(spark, sf):
    return norm.places(_prepared(spark, sf)).select("status_id", "pname", "bb_type")


@query(
    "csv_challenge",
    """select * replace (round(botscore, 9) as botscore) from challenge""",
)
def _(spark, sf):
    path = run_dir(spark, "challenge-csv")
    columns = ["user_id", "parent_screen_name", "parent_id", "botscore"]
    tables.write_csv(fx.challenge(spark, sf).select(columns), path)
    return tables.read_challenge(spark, path)


@query(
    "challenge_backup",
    """select user_id, parent_screen_name, parent_id, round(botscore, 9) as botscore,
              maxtweetid from challenge""",
)
def _(spark, sf):
    path = run_dir(spark, "challenge-backup")
    tables.backup_challenge(fx.challenge(spark, sf), path)
    return spark.read.schema(CHALLENGE).options(sep=",", header=True).csv(path)


@query(
    "csv_new_sources",
    """select status_source as source, 'new; "unseen"' as comment,
              0.0::double as botscore, 0.0::double as kobotscore
       from history
       where status_source not in (select source from source_q) group by 1
       union all
       select source, null, botscore, kobotscore from source_q""",
)
def _(spark, sf):
    path = run_dir(spark, "sources-csv")
    known = fx.source_q(spark)
    new = reports.unqualified_sources(fx.history(spark, sf), known).select(
        F.col("status_source").alias("source"),
        F.lit('new; "unseen"').alias("comment"),
        F.lit(0.0).alias("botscore"),
        F.lit(0.0).alias("kobotscore"),
    )
    tables.backup_source_qualification(new, path)
    return tables.extend_source_qualification(
        known.withColumn("comment", F.nullif("comment", F.lit(""))),
        tables.read_source_qualification(spark, path),
    )


@query(
    "reset_counts",
    """select 'status' as tabelle, count(*) as anz, cast(0 as bigint) as anz_nachher
       from old_posts
       union all select 'users', count(*), 0 from users
       union all select 'challenge', count(*), count(*) from challenge""",
)
def _(spark, sf):
    frames = {
        "status": fx.old_posts(spark, sf),
        "users": fx.users(spark, sf),
        "challenge": fx.challenge(spark, sf),
    }
    after = tables.row_counts(tables.reset_facts(frames, run_dir(spark, "reset")))
    after = after.withColumnRenamed("anz", "anz_nachher")
    return tables.row_counts(frames).join(after, "tabelle")


# ------------------------------------------------------------- streaming


KEPT = """select id, status_user_id, date_trunc('second', created_at) as created_at,
              lang, cast(n_mentions as bigint) as n_mentions from posts"""


def _stored_posts(spark, out):
    return ingest.read_table(spark, out, "status").select(
        "id",
        "status_user_id",
        "created_at",
        "lang",
        F.size("mentions").alias("n_mentions"),
    )


@fx.once
def _ingested(spark, sf) -> str:
    """All lines of the stream, taken in by the streaming job."""
    base = run_dir(spark, "stream")
    fx.lines(spark, sf).write.text(f"{base}/in", compression="gzip")
    job = ingest.ingest_stream(
        spark,
        f"{base}/in",
        f"{base}/out",
        f"{base}/checkpoint",
        session_id=1,
        maxFilesPerTrigger="64",
    )
    job.awaitTermination()
    return f"{base}/out"


@query(
    "stream_report",
    """select 'status' as kind, count(*) as anz from events
       union all select 'delete', count(*) from labels where toxic = 1
       union all select 'corrupt', count(*) from conversations
       union all select 'limit', count(*) from supplier
       union all select 'scrub_geo', count(*) from region
       union all select 'warning', count(*) from nation""",
)
def _(spark, sf):
    report = ingest.read_table(spark, _ingested(spark, sf), "_report")
    return report.groupBy("kind").agg(F.sum("anz").alias("anz"))


@query(
    "stream_ingest",
    KEPT,
)
def _(spark, sf):
    return _stored_posts(spark, _ingested(spark, sf))


@query(
    "ingest_replay",
    """select a.id, p.id as status_id, false as seen_before, true as same_key
       from accounts a join posts p on p.status_user_id = a.id""",
)
def _(spark, sf):
    """A batch that broke off between two tables, then its repetition: whether a
    snapshot was visible before, and has the key that the first attempt gave it."""
    out = run_dir(spark, "replay")
    arrived = ingest.arrive(fx.tweets(spark, sf), 0, out)
    first = ingest.batch_tables(arrived, session_id=1)["users"]
    ingest.write_batch(first, f"{out}/users", 0, "id")
    early = ingest.read_table(spark, out, "users").select("id", "status_id", F.lit(True).alias("early"))
    key = ["id", "status_id", "recorded_at"]
    kept = materialise(spark.read.parquet(f"{out}/users").select(*key, F.lit(True).alias("kept")), f"{out}/first")
    early = materialise(early, f"{out}/early")
    ingest.store_batch(fx.tweets(spark, sf), 0, out, session_id=1)
    users = ingest.read_table(spark, out, "users").select(key)
    found = users.join(kept, key, "left").join(early, ["id", "status_id"], "left")
    return found.select(
        "id",
        "status_id",
        F.coalesce("early", F.lit(False)).alias("seen_before"),
        F.coalesce("kept", F.lit(False)).alias("same_key"),
    )


@query(
    "ingest_resume",
    f"""select k.*, cast(1 as bigint) as n_sessions, 'the,des' as track_topics
        from ({KEPT}) k""",
)
def _(spark, sf):
    """A collection that stops after part of its files and is resumed by its session:
    each post once, one session row."""
    base = run_dir(spark, "resume")
    number = F.xxhash64("value") % 2
    session_id = None
    for half in (number == 0, number != 0):
        session_id = open_session(
            spark, f"{base}/sessions", session_id=session_id, track=["the", "des"]
        )
        fx.messages(spark, sf).where(half).write.mode("append").text(f"{base}/in", compression="gzip")
        # lines go when the batch after theirs begins
        ingest.ingest_stream(
            spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", session_id=session_id,
            cleanSource="delete",
        ).awaitTermination()
    sessions = spark.read.schema(SESSION).parquet(f"{base}/sessions")
    known = sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"), F.max("track_topics").alias("track_topics")
    )
    posts = _stored_posts(spark, f"{base}/out")
    return posts.crossJoin(F.broadcast(known))


@query(
    "ingest_once",
    f"""select k.*, cast(1 as bigint) as with_option, cast(2 as bigint) as without
        from ({KEPT}) k""",
)
def _(spark, sf):
    """All posts sent in two batches: how often each is stored with and without the
    option that remembers ids."""
    base = run_dir(spark, "once")
    sent = [0]
    for _ in range(2):
        fx.messages(spark, sf).write.mode("append").text(f"{base}/in", compression="gzip")
        sent.append(len([f for f in folders(spark, f"{base}/in") if f.startswith("part-")]))
    # the files of a sending are a batch, of as many tasks
    each = str(max(1, sent[1], sent[2] - sent[1]))
    counts = []
    for name, within in (("with_option", "2 days"), ("without", None)):
        out = f"{base}/{name}"
        # the last reader of lines takes them away
        read = {"cleanSource": "delete"} if within is None else {}
        ingest.ingest_stream(
            spark, f"{base}/in", out, f"{out}-checkpoint", session_id=1, once_within=within,
            maxFilesPerTrigger=each, **read,
        ).awaitTermination()
        posts = _stored_posts(spark, out)
        count = posts.groupBy(*posts.columns).agg(F.count(F.lit(1)).alias(name))
        counts.append(materialise(count, f"{base}/{name}-counts"))
        remove(spark, out)  # one set of tables at a time
    key = ["id", "status_user_id", "created_at", "n_mentions"]
    return counts[0].join(counts[1].drop("lang"), key)


@query(
    "ingest_compacted",
    f"""select k.*, true as before, true as while_packing, true as fewer_files
        from ({KEPT}) k""",
)
def _(spark, sf):
    """Batches packed into a generation: each post as before and in a reader that began
    before, in fewer files."""
    base = run_dir(spark, "packed")
    out = f"{base}/out"
    # three batches at least: files of a third of the posts at most, and a third of the files
    posts = fx.messages(spark, sf)
    third = str(max(1, -(-posts.count() // 3)))
    posts.write.option("maxRecordsPerFile", third).text(f"{base}/in", compression="gzip")
    sent = [f for f in folders(spark, f"{base}/in") if f.startswith("part-")]
    each = str(max(1, len(sent) // 3))
    # lines go when the batch after theirs begins
    ingest.ingest_stream(
        spark, f"{base}/in", out, f"{base}/checkpoint", session_id=1, maxFilesPerTrigger=each,
        cleanSource="delete",
    ).awaitTermination()
    begun = ingest.read_table(spark, out, "status")
    before = materialise(begun.select("id", F.lit(True).alias("before")), f"{base}/before")
    files = len(begun.inputFiles())
    ingest.compact_tables(spark, out)
    packed = ingest.read_table(spark, out, "status").inputFiles()
    fewer = F.lit(len([f for f in packed if "_generations" in f]) < files)
    meanwhile = begun.select("id", F.lit(True).alias("while_packing"))
    found = _stored_posts(spark, out).join(before, "id", "left").join(meanwhile, "id", "left")
    return found.withColumn("fewer_files", fewer)


@query(
    "stream_facts",
    rounded(
        "live_single_score where userid in (select status_user_id from posts)",
        "totalscore",
        "userid",
    ),
)
def _(spark, sf):
    """Scores after three micro-batches, each from its own posts and stored facts."""
    base = run_dir(spark, "facts")
    fx.posts(spark, sf).drop("status_text").repartition(3).write.parquet(f"{base}/posts")
    people = fx.users(spark, sf)
    recorded = ["id", "recorded_at", "session_id"]

    def snapshots(batch, batch_id):
        """Those of the batch's posts, and once those of all customers."""
        wanted = batch.select(
            F.col("status_user_id").alias("id"), "recorded_at", "session_id"
        ).distinct()
        known = people.where(F.col("recorded_at") == F.lit(fx.AS_OF))
        found = people.join(wanted, recorded, "left_semi")
        return found.unionByName(known) if batch_id == 0 else found

    arriving = (
        spark.readStream.schema(spark.read.parquet(f"{base}/posts").schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{base}/posts")
    )
    rolling.rolling_scores(
        arriving,
        snapshots,
        fx.source_q(spark),
        f"{base}/out",
        f"{base}/checkpoint",
        as_of=lambda: fx.AS_OF,
    ).awaitTermination()
    return rescore.latest_scores(spark, f"{base}/out")


@query(
    "stream_rescore",
    rounded(
        "live_single_score where userid in (select status_user_id from posts)",
        "totalscore",
        "userid",
    ),
)
def _(spark, sf):
    base = run_dir(spark, "rescore")
    fx.posts(spark, sf).drop("status_text").write.parquet(f"{base}/history")

    def history():
        stored = spark.read.parquet(f"{base}/history")
        return stored, fx.users(spark, sf)

    arriving = spark.readStream.schema(
        spark.read.parquet(f"{base}/history").schema
    ).parquet(f"{base}/history")
    rescore.rescore_stream(
        arriving,
        history,
        fx.source_q(spark),
        f"{base}/scores",
        f"{base}/checkpoint",
        as_of=lambda: fx.AS_OF,
    ).awaitTermination()
    return rescore.latest_scores(spark, f"{base}/scores")


@query(
    "stream_positions",
    "select status_user_id as userid, max(id) as tweetid from posts group by 1",
)
def _(spark, sf):
    base = run_dir(spark, "positions")
    events = spark.read.parquet(f"{sf}/events.parquet")
    arriving = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("status_user_id"))
    )

    def store(batch, batch_id):
        ingest.write_batch(batch, f"{base}/positions", batch_id)

    (
        rescore.stream_positions(arriving)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    written = spark.read.parquet(f"{base}/positions")
    return written.groupBy("userid").agg(F.max("tweetid").alias("tweetid"))
