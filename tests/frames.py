"""Small frames from keyword rows, and results as plain dictionaries."""

from datetime import datetime, timedelta, timezone

from flockscore import schemas

T0 = datetime(2024, 1, 10, 12, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


STATUS = ("id recorded_at created_at session_id status_user_id lang status_source "
          "status_text isretweet in_reply_to_status_id mentions urls hashtags").split()
USERS = ("id recorded_at session_id screen_name description created_at lang "
         "followers_count friends_count utcoffset").split()


def status(spark, *rows):
    """Posts; ``u`` is the author, ``t`` seconds after T0, ``reply`` the parent."""
    full = []
    for n, row in enumerate(rows):
        made = row.get("created_at", at(row.get("t", 0)))
        values = {
            "id": row.get("id", n + 1),
            "recorded_at": row.get("recorded_at", made),
            "created_at": made,
            "session_id": row.get("session", 0),
            "status_user_id": row.get("u", 1),
            "lang": row.get("lang", "de"),
            "status_source": row.get("source"),
            "status_text": row.get("text", "text"),
            "isretweet": row.get("retweet", 0),
            "in_reply_to_status_id": row.get("reply"),
            "mentions": [(9, 0, 1, "u", "u", "u")] * row.get("mentions", 0),
            "urls": [(x, x, 0, 1, x, x) for x in row.get("urls", [])],
            "hashtags": [(0, 1, x) for x in row.get("tags", [])],
        }
        full.append(tuple(values[c] for c in STATUS))
    return spark.createDataFrame(full, schemas.STATUS)


def users(spark, *rows):
    full = []
    for row in rows:
        values = {
            "id": row.get("id", 1),
            "recorded_at": row.get("recorded_at", at(row.get("t", 0))),
            "session_id": row.get("session", 0),
            "screen_name": row.get("name", "somebody"),
            "description": row.get("about", "text"),
            "created_at": row.get("created_at", at(0)),
            "lang": row.get("lang", "de"),
            "followers_count": row.get("followers", 10),
            "friends_count": row.get("friends", 10),
            "utcoffset": row.get("offset", 0),
        }
        full.append(tuple(values[c] for c in USERS))
    return spark.createDataFrame(full, schemas.USERS)


def snapshots(spark, posts, **by_user):
    """One snapshot per post; ``by_user`` gives values such as u1={"offset": 3}."""
    rows = []
    for p in posts.collect():
        values = by_user.get(f"u{p.status_user_id}", {})
        rows.append(
            {
                **values,
                "id": p.status_user_id,
                "recorded_at": p.recorded_at.replace(tzinfo=timezone.utc)
                if p.recorded_at.tzinfo is None
                else p.recorded_at,
                "session": p.session_id,
            }
        )
    unique = {(r["id"], r["recorded_at"], r["session"]): r for r in rows}
    return users(spark, *unique.values())


def source_q(spark, **scores):
    """Clients as name=(score, flag)."""
    rows = [(name, "", float(b), float(k)) for name, (b, k) in scores.items()]
    return spark.createDataFrame(rows, schemas.SOURCE_Q)


def challenge(spark, *rows):
    """(user_id, botscore) pairs."""
    full = [(u, "parent", 7, score, 1) for u, score in rows]
    return spark.createDataFrame(full, schemas.CHALLENGE)


def session(spark, *topics):
    rows = [(n, topic, "", "streaming") for n, topic in enumerate(topics)]
    return spark.createDataFrame(rows, schemas.SESSION)


def scores(df, column="botscore"):
    """{userid: score}."""
    rows = df.select("userid", column).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1] for r in rows}
