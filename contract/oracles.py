"""The registered queries as DuckDB SQL, put together from common table
expressions. Names of frames and columns are those of the library."""

from __future__ import annotations

import re

# Fixed values, stated here once more: a wrong list in the library must show.
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
    "PROFILEAGE",
    "NAMDESCLEN",
    "ANZFOLLOW",
    "TWEETMENTION",
    "DECILPOSTS",
    "LANGUSERTWEETS",
    "TWEETFREQ",
    "STATUSFREQUENCY",
    "REACTIONTIME",
    "TWEETLANGS",
    "TWEETCOUNT",
    "SOURCEQUALIFICATION",
)
TOPIC_PHRASES = ("/", "@", "|", "#afd", "#", "https", "http", "tco", "...")
TOPIC_STOPWORDS = ("tco", "nein", "los", "afd", "erst", "the", "you", "dass")
FOLLOWER_PHRASES = (
    "https://t.co/", "http://t.co/", "http://", "https://", "@", "|", "#", "...",
)
FOLLOWER_STOPWORDS = (
    "tco", "nein", "los", "erst", "the", "you", "dass", "and", "for", "mal", "via",
    "with", "https", "http", "this",
)

CTES: dict[str, str] = {}

# ---------------------------------------------------------------- frames

CTES["posts"] = """
    select e.event_id as id, e.ts as recorded_at, e.ts as created_at,
           e.event_id % 3 as session_id, e.user_id as status_user_id,
           if(d.lang = 'es', 'und', d.lang) as lang,
           e.event_type as status_source,
           d.text || if(e.event_id % 7 = 0,
               ' (#gameinsight) the-new/www https://t.co/ab12...', '') as status_text,
           if(e.event_id % 5 = 0, 1, 0) as isretweet,
           if(e.event_id % 4 = 0 and e.event_id > 7,
              e.event_id - 1 - e.event_id % 7, null) as reply_to,
           if(e.event_id % 10 < e.user_id % 10, 1, 0) as n_mentions,
           if(e.event_id % 2 = 0, d.source, null) as second_tag
    from events e, (select count(*) as size from documents) n
    join documents d on d.doc_id = e.event_id % n.size"""
CTES["links"] = """
    select p.status_user_id as userid, g.url
    from posts p, (select count(*) as size from pages) n
    join pages g on g.page_id = p.id % n.size
    where p.status_source in ('click', 'view')"""
CTES["tags"] = """
    select status_user_id as userid, unnest([status_source, second_tag]) as tag
    from posts"""
CTES["old_links"] = """
    select o.o_custkey as userid, g.url
    from orders o, (select count(*) as size from pages) n
    join pages g on g.page_id = o.o_orderkey % n.size
    where o.o_orderpriority in ('1-URGENT', '2-HIGH')"""
CTES["old_tags"] = """
    select o_custkey as userid, unnest([o_orderstatus, o_orderpriority]) as tag
    from orders"""
CTES["accounts"] = """
    select c_custkey as id,
           case when c_custkey % 6 = 0 then substr(c_mktsegment, 1, 5)
                when c_custkey % 3 <> 2 then c_mktsegment else c_name
           end as screen_name,
           if(c_custkey % 4 = 0, '', c_mktsegment) as description,
           timestamp '2024-01-31' - to_seconds(c_custkey * 13 % 700 * 86400
               + c_custkey * 7919 % 86400) as created_at,
           case c_custkey % 4 when 0 then 'de' when 1 then 'fr' else 'en'
           end as lang,
           cast(floor(abs(c_acctbal)) as int) as followers_count,
           cast(c_custkey * 37 % 5 * 1000 as int) as friends_count,
           if(c_custkey % 11 = 0, null,
              cast((c_nationkey % 24 - 11) * 3600 as int)) as utcoffset
    from customer"""
CTES["users"] = """
    select a.*, timestamp '2024-01-31' as recorded_at, 0 as session_id
    from accounts a
    union all
    select a.* replace (cast(a.followers_count + e.event_id % 50 as int)
                        as followers_count),
           e.ts as recorded_at, e.event_id % 3 as session_id
    from accounts a join events e on e.user_id = a.id"""
CTES["old_posts"] = """
    select 1000000000000 + o_orderkey as id,
           made + to_microseconds(o_orderkey) as recorded_at,
           made as created_at, 3 as session_id, o_custkey as status_user_id,
           case o_orderpriority when '1-URGENT' then 'en' when '2-HIGH' then 'de'
                when '3-MEDIUM' then 'fr' else 'und' end as lang,
           o_orderstatus as status_source, 0 as isretweet,
           if(o_orderpriority = '1-URGENT', 1000000000000 + o_orderkey - 1, null)
               as reply_to,
           if(o_orderkey % 10 < o_custkey % 10, 1, 0) as n_mentions
    from (select *, o_orderdate + to_seconds(o_orderkey * 7 % 86400) as made
          from orders)"""
CTES["history"] = """
    select id, recorded_at + interval 1 day as recorded_at, created_at,
           3 as session_id, status_user_id, lang, status_source, isretweet,
           reply_to, n_mentions
    from posts
    union all select * from old_posts"""
CTES["history_users"] = """
    select a.* replace (cast(a.followers_count + h.id % 50 as int)
                        as followers_count),
           h.recorded_at, h.session_id
    from accounts a join history h on h.status_user_id = a.id"""
CTES["source_q"] = """
    select * from (values ('click', 0.0::double, 0.0::double), ('view', 0.2, 0.0),
        ('error', 1.0, 1.0), ('signup', 0.5, 1.0)) t(source, botscore, kobotscore)"""
CTES["session"] = """
    select * from (values (0, '#a'), (1, '#b,#c'), (2, '#d')) t(id, track_topics)"""
CTES["challenge"] = """
    with listed as (
        select c_custkey as user_id, c_mktsegment as parent_screen_name,
               cast(c_nationkey as bigint) as parent_id,
               if(c_custkey % 10 = 3, null, (c_custkey * 17 % 101) / 100.0::double)
                   as botscore,
               cast(1 as bigint) as maxtweetid
        from customer)
    select * from listed
    union all
    select * replace (parent_id + 100 as parent_id) from listed
    where parent_screen_name = 'BUILDING'"""

# ------------------------------------------------------------ indicators

CTES["k_profileage"] = """
    select 'PROFILEAGE' as kpiname, userid,
           if(profileage > 365, 0.0, 1 - profileage / 365) as botscore, profileage
    from (select id as userid,
                 date_part('year', a) * 365.25 + date_part('month', a) * 30
                 + date_part('day', a) + (date_part('hour', a) * 3600
                 + date_part('minute', a) * 60 + date_part('second', a))
                 / 86400.0::double as profileage
          from (select id, age(timestamp '2024-01-31', min(created_at)) as a
                from users group by id))"""
CTES["k_namdesclen"] = """
    select 'NAMDESCLEN' as kpiname, userid,
           if((profilenamelen < 8 and desclen = 0) or digits, 1.0, 0.0) as botscore,
           profilenamelen, desclen
    from (select id as userid, avg(length(screen_name)) as profilenamelen,
                 avg(length(description)) as desclen,
                 bool_or(regexp_matches(screen_name, '[0-9]')) as digits
          from users group by id)"""
CTES["k_anzfollow"] = """
    select 'ANZFOLLOW' as kpiname, userid,
           if(ratiofolfriend < 1, 1 - ratiofolfriend, 0.0) as botscore,
           anzfollower, anzfriends, ratiofolfriend
    from (select id as userid, avg(followers_count) as anzfollower,
                 avg(friends_count) as anzfriends,
                 avg(followers_count) / nullif(avg(friends_count), 0)
                     as ratiofolfriend
          from users group by id)"""
CTES["k_tweetmention"] = """
    select 'TWEETMENTION' as kpiname, userid,
           if(umprotweet < 0.5, 1 - umprotweet, 0.0) as botscore,
           anzahltweets, umprotweet
    from (select status_user_id as userid, count(*) as anzahltweets,
                 sum(n_mentions) / count(*)::double as umprotweet
          from posts group by 1)"""
CTES["k_decilposts"] = """
    select 'DECILPOSTS' as kpiname, userid,
           if(decil > 10, decil / 20.0::double, 0.0) as botscore,
           sessionid, anz, decil
    from (select *, ntile(20) over (
                 order by anz, userid % 1021, userid, sessionid) as decil
          from (select status_user_id as userid, session_id as sessionid,
                       count(*) as anz from posts group by 1, 2))"""
CTES["k_langusertweets"] = """
    select 'LANGUSERTWEETS' as kpiname, status_user_id as userid,
           avg(case when p.lang = 'und' then 0.2::double
                    when p.lang = u.lang then 0 else 1 end) as botscore
    from posts p join users u on u.id = p.status_user_id
         and u.recorded_at = p.recorded_at and u.session_id = p.session_id
    group by 2"""


def _both(columns: str, both: bool, where: str = "true") -> str:
    """Distinct rows of one dataset, or of both."""
    parts = [f"select {columns} from posts where {where}"]
    if both:
        parts.append(f"select {columns} from history where {where}")
    return " union ".join(parts) if both else parts[0].replace(
        "select", "select distinct", 1
    )


def tweetfreq(seconds: float = 5, both: bool = False) -> str:
    return f"""
    select 'TWEETFREQ' as kpiname, userid,
           if(min(gap) < {seconds}, 1.0, 0.0) as botscore, min(gap) as mingap
    from (select userid, (epoch_us(created_at) - lag(epoch_us(created_at)) over (
                     partition by userid order by created_at)) / 1e6 as gap
          from ({_both("status_user_id as userid, created_at", both)}))
    where gap is not null group by userid"""


def _local(both: bool, columns: str) -> str:
    pairs = [("posts", "users")] + ([("history", "history_users")] if both else [])
    return " union ".join(
        f"""
        select {'' if both else 'distinct'} p.id, p.status_user_id as userid,
               {columns},
               p.created_at + to_seconds(u.utcoffset) as local_at
        from {p} p join {u} u on u.id = p.status_user_id
             and u.recorded_at = p.recorded_at and u.session_id = p.session_id"""
        for p, u in pairs
    )


def statusfrequency(both: bool = False) -> str:
    counts = ", ".join(
        f"count(*) filter (hour(local_at) = {h}) as uhr{h}" for h in range(24)
    )
    return f"""
    select 'STATUSFREQUENCY' as kpiname, userid,
           if(uhr1 + uhr2 + uhr3 + uhr4 > 0, 1.0, 0.0) as botscore,
           columns('uhr.*')
    from (select userid, {counts}
          from ({_local(both, "p.created_at, u.utcoffset")}) group by userid)"""


def reactiontime(both: bool = False, self_only: bool = False) -> str:
    own = "and parent.userid = reply.userid" if self_only else ""
    return f"""
    select 'REACTIONTIME' as kpiname, userid,
           if(min(gap) < 5000000, 1.0, 0.0) as botscore,
           min(gap) / 1e6 as minawz, 
           sum(gap)::double / count(gap) / 1e6 as mittelawz,
           max(gap) / 1e6 as maxawzeit, count(gap) as anzawzeit
    from (with local_posts as ({_local(both, "p.reply_to")})
          select reply.userid,
                 epoch_us(reply.local_at) - epoch_us(parent.local_at) as gap
          from local_posts reply join local_posts parent
               on parent.id = reply.reply_to {own})
    group by userid"""


def tweetlangs(both: bool = False, own: bool = False) -> str:
    where = "isretweet = 0" if own else "true"
    return f"""
    select 'TWEETLANGS' as kpiname, userid,
           if(count(distinct lang) / count(*)::double > 0.06, 1.0, 0.0) as botscore,
           count(distinct lang) as anzlang, count(*) as anztweets
    from ({_both("id, status_user_id as userid, lang", both, where)})
    where lang <> 'und' group by userid"""


def tweetcount(per_day: int = 50, both: bool = False) -> str:
    return f"""
    select 'TWEETCOUNT' as kpiname, userid,
           if(max(n) > {per_day}, 1.0, 0.0) as botscore
    from (select userid, count(*) as n
          from ({_both("id, status_user_id as userid, created_at", both)})
          group by userid, strftime(created_at, '%d.%m.%Y'))
    group by userid"""


CTES["k_tweetfreq"] = tweetfreq()
CTES["k_statusfrequency"] = statusfrequency()
CTES["k_reactiontime"] = reactiontime()
CTES["k_reactiontime_self"] = reactiontime(self_only=True)
CTES["k_tweetlangs"] = tweetlangs()
CTES["k_tweetlangs_own"] = tweetlangs(own=True)
CTES["k_tweetcount"] = tweetcount()
CTES["b_statusfrequency"] = statusfrequency(both=True)
CTES["b_reactiontime"] = reactiontime(both=True)
CTES["b_tweetlangs"] = tweetlangs(both=True)
CTES["b_tweetfreq"] = tweetfreq(both=True)
CTES["b_tweetcount"] = tweetcount(both=True)
CTES["qualified"] = """
    select p.id, min(p.status_user_id) as userid,
           avg(coalesce(q.botscore, 0)) as botscore,
           max(coalesce(q.kobotscore, 0)) as kobotscore
    from posts p left join source_q q on q.source = p.status_source
    group by p.id"""
CTES["k_sourcequalification"] = """
    select 'SOURCEQUALIFICATION' as kpiname, userid, avg(botscore) as botscore
    from qualified group by userid"""
CTES["k_ko_source"] = """
    select 'KOSOURCEQUALIFICATION' as kpiname, userid,
           if(avg(kobotscore) > 0.5, 1.0, 0.0) as kobotscore
    from qualified group by userid"""

# the same indicators over the fetched history
for _name in [n for n in CTES if n.startswith("k_") or n == "qualified"]:
    _sql = re.sub(r"\busers\b", "history_users", re.sub(r"\bposts\b", "history", CTES[_name]))
    CTES["h" + _name.removeprefix("k")] = re.sub(r"\bqualified\b", "hqualified", _sql)

# ----------------------------------------------------------- composition


def _long(names, prefix: dict[str, str] | None = None) -> str:
    """Indicators in long form; equal rows once."""
    prefix = prefix or {}
    return " union ".join(
        f"select kpiname, userid, botscore from {prefix.get(n, 'k_' + n.lower())}"
        for n in names
    )


def _grid(names, universe: str) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return (
        f"select userid, kpiname from ({universe}) "
        f"cross join (values {values}) w(kpiname)"
    )


LISTED = "select distinct user_id as userid from challenge"
WRITERS = "select distinct status_user_id as userid from posts"
FETCHED = "select distinct status_user_id as userid from history"
BOTH = {n: "b_" + n.lower() for n in STAGE2_KPIS}
PERUSER_KPIS = [n for n in BATCH_KPIS if n != "DECILPOSTS"]
OWN = {"REACTIONTIME": "k_reactiontime_self", "TWEETLANGS": "k_tweetlangs_own"}
# Scores of accounts without rows where single ones are scored.
ABSENT = {
    "NAMDESCLEN": 1.0,
    "TWEETMENTION": 1.0,
    "ANZFOLLOW": 0.0,
    "TWEETFREQ": 0.0,
    "STATUSFREQUENCY": 0.0,
    "REACTIONTIME": 0.0,
    "TWEETLANGS": 0.0,
    "TWEETCOUNT": 0.0,
}

CTES["stage1"] = f"""
    select kpiname, userid, coalesce(botscore, 0) as botscore, 1.0 as weight
    from ({_grid(STAGE1_KPIS, WRITERS)}) g
    left join ({_long(STAGE1_KPIS)}) k using (kpiname, userid)"""
CTES["stage1_total"] = """
    select userid, round(sum(botscore * weight) / sum(weight), 9) as totalbotscore
    from stage1 group by userid"""
CTES["stage2"] = f"""
    select kpiname, userid, coalesce(botscore, 0) as botscore, 1.0 as weight
    from ({_grid(STAGE2_KPIS, FETCHED)}) g
    left join ({_long(STAGE2_KPIS, BOTH)}) k using (kpiname, userid)"""
CTES["common"] = f"""
    select userid, s.botscore, s.weight
    from ({FETCHED}) f left join stage1 s using (userid)"""
CTES["stage2_total"] = """
    select userid, round(sum(botscore * weight) / sum(weight), 9) as totalbotscore
    from (select userid, botscore, weight from stage2
          union select userid, botscore, weight from common)
    group by userid"""
CTES["bots2"] = "select userid from stage2_total where totalbotscore > 0.5"
CTES["bots1"] = "select userid from stage1_total where totalbotscore > 0.5"
HISTORY = {n: "h_" + n.lower() for n in BATCH_KPIS}
CTES["batch"] = f"""
    select kpiname, userid, botscore, 1.0 as weight
    from ({_grid(BATCH_KPIS, LISTED)}) g
    left join ({_long(BATCH_KPIS, HISTORY)}) k using (kpiname, userid)"""
CTES["batch_total"] = """
    select userid, round(sum(botscore * weight) / sum(weight), 9) as totalbotscore
    from batch group by userid"""
CTES["ko"] = f"""
    select kpiname, userid, kobotscore
    from ({_grid(["KOSOURCEQUALIFICATION"], LISTED)}) g
    left join h_ko_source k using (kpiname, userid)"""
CTES["ko_total"] = """
    select userid, max(kobotscore) as totalkobotscore from ko group by userid"""
CTES["integrated"] = """
    select userid, greatest(totalkobotscore, totalbotscore) as totalscore
    from batch_total full join ko_total using (userid)"""
_default = " ".join(f"when '{n}' then {v}" for n, v in ABSENT.items())


def _single(prefix: str, dataset: str) -> None:
    """Scores of single accounts from one dataset: indicators, total, score."""
    names = {n: f"{dataset}_{n.lower()}" for n in PERUSER_KPIS}
    names |= {n: re.sub("^k", dataset, own) for n, own in OWN.items()}
    CTES[f"{prefix}"] = f"""
    select kpiname, userid,
           coalesce(botscore, case kpiname {_default} end) as botscore
    from ({_grid(PERUSER_KPIS, LISTED)}) g
    left join ({_long(PERUSER_KPIS, names)}) k using (kpiname, userid)"""
    CTES[f"{prefix}_total"] = f"""
    select userid, round(avg(botscore), 9) as totalbotscore
    from {prefix} group by userid"""
    CTES[f"{prefix}_score"] = f"""
    select t.userid, greatest(totalbotscore, coalesce(kobotscore, 0)) as totalscore
    from {prefix}_total t left join {dataset}_ko_source k using (userid)"""


_single("single", "h")
_single("live_single", "k")

# ----------------------------------------------------------------- texts

CTES["topic_posts"] = """
    select s.track_topics, p.id, p.created_at, p.status_text,
           p.status_user_id in (select userid from bots1) as is_bot
    from posts p join session s on s.id = p.session_id"""
CTES["listed_posts"] = """
    select p.id, p.created_at, p.status_text,
           coalesce(c.botscore > 0.5, false) as is_bot
    from posts p join challenge c on c.user_id = p.status_user_id
    where p.status_text not like '%#gameinsight%'"""


def text_parts(source: str, by: str, part_chars: int = 2_000_000) -> str:
    order = "minute, lane, created_at, id"
    return f"""
    select {by}, part, string_agg(t, ' ' order by {order}) as text
    from (select *, cast(floor(coalesce(start, 0) / {part_chars}) as bigint) as part
          from (select *, sum(length(t) + 1) over (partition by {by} order by {order}
                         rows between unbounded preceding and 1 preceding) as start
                from (select *, lower(status_text) as t, id % 64 as lane,
                             date_trunc('minute', created_at) as minute
                      from {source} where status_text is not null)))
    group by {by}, part"""


def _without(text: str, words) -> str:
    """``text`` less the given words, by runs of word and other characters."""
    stop = ", ".join(f"'{w}'" for w in words)
    runs = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    return f"array_to_string(list_filter({runs}, lambda r: r not in ({stop})), '')"


def term_frequencies(source: str, keys: str, phrases, stopwords, own) -> str:
    text = "lower(status_text)"
    for phrase in phrases:
        text = f"replace({text}, '{phrase}', ' ')"
    text = f"regexp_replace({text}, '[0-9]+', '', 'g')"
    text = _without(text, stopwords)
    text = f"regexp_replace({text}, '[!-/:-@\\[-`{{-~]+', '', 'g')"
    text = _without(text, own)
    by = f"{keys}, is_bot" if keys else "is_bot"
    return f"""
    select {by}, word, freq
    from (select *, row_number() over (partition by {by} order by freq desc, word)
                     as rank
          from (select {by}, word, count(*) as freq
                from (select {by}, unnest(string_split_regex({text},
                             '[ \\t\\r\\n\\x0b\\f]+')) as word from {source})
                where length(word) >= 3
                group by {by}, word having count(*) >= 3))
    where rank <= 200"""


TOPIC_TERMS = term_frequencies(
    "topic_posts",
    "track_topics",
    TOPIC_PHRASES,
    ("der", "die", "und", "les", "des", "and", "was"),
    TOPIC_STOPWORDS,
)
FOLLOWER_TERMS = term_frequencies(
    "listed_posts",
    "",
    FOLLOWER_PHRASES,
    ("der", "die", "und", "les", "des", "and", "was"),
    FOLLOWER_STOPWORDS,
)


def with_ctes(final: str) -> str:
    """``final`` with all expressions it needs, in order of definition."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = ",\n".join(f"{n} as ({CTES[n]})" for n in CTES if n in needed)
    return f"with {parts}\n{final}" if parts else final
