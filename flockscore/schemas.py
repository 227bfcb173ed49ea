"""Column layouts of the frames, as Spark DDL, and the fixed weights."""

MENTION = (
    "struct<user_id:bigint,start:int,end:int,username:string,"
    "screen_name:string,text:string>"
)
URL = (
    "struct<display_url:string,expanded_url:string,start:int,end:int,"
    "url:string,text:string>"
)
HASHTAG = "struct<start:int,end:int,text:string>"
MEDIA = (
    "struct<media_url:string,media_url_https:string,media_type:string,"
    "display_url:string,expanded_url:string,start:int,end:int,url:string,"
    "text:string,sizes:string>"
)

# What the indicators and reports read.
STATUS = f"""
    id bigint, recorded_at timestamp, created_at timestamp, session_id bigint,
    status_user_id bigint, lang string, status_source string,
    status_text string, isretweet int, in_reply_to_status_id bigint,
    mentions array<{MENTION}>, urls array<{URL}>, hashtags array<{HASHTAG}>
"""
USERS = """
    id bigint, recorded_at timestamp, session_id bigint, screen_name string,
    description string, created_at timestamp, lang string,
    followers_count int, friends_count int, utcoffset int
"""
SESSION = """
    id bigint, track_topics string, track_followers string, datasource string
"""
SOURCE_Q = "source string, comment string, botscore double, kobotscore double"
CHALLENGE_CSV = """
    user_id bigint, parent_screen_name string, parent_id bigint,
    botscore double
"""
CHALLENGE = CHALLENGE_CSV + ", maxtweetid bigint"
FOLLOWER = "userid bigint, maxtweetid bigint, botscore double"

# One tweet as delivered on the wire (one JSON object per line). The control
# messages of the stream arrive as lines with one of the last four fields.
_ENTITY_URL = (
    "struct<url:string,expanded_url:string,display_url:string,"
    "indices:array<int>>"
)
_POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
TWEET_JSON = f"""
    id bigint, created_at string, text string, lang string, source string,
    favorite_count int, retweet_count int,
    favorited boolean, retweeted boolean, truncated boolean,
    possibly_sensitive boolean, withheld_in_countries array<string>,
    in_reply_to_screen_name string, in_reply_to_status_id bigint,
    in_reply_to_user_id bigint, quoted_status_id bigint,
    retweeted_status struct<id:bigint>,
    current_user_retweet struct<id:bigint>,
    coordinates struct<type:string,coordinates:array<double>>,
    place struct<name:string,full_name:string,url:string,country:string,
        country_code:string,place_type:string,street_address:string,
        bounding_box:{_POLYGON},geometry:{_POLYGON}>,
    entities struct<
        hashtags:array<struct<text:string,indices:array<int>>>,
        urls:array<{_ENTITY_URL}>,
        user_mentions:array<struct<id:bigint,name:string,screen_name:string,
            indices:array<int>>>,
        media:array<struct<media_url:string,media_url_https:string,
            type:string,display_url:string,expanded_url:string,url:string,
            indices:array<int>,sizes:string>>>,
    user struct<id:bigint,name:string,screen_name:string,created_at:string,
        description:string,geo_enabled:boolean,lang:string,
        followers_count:int,favourites_count:int,friends_count:int,
        listed_count:int,location:string,statuses_count:int,time_zone:string,
        url:string,utc_offset:int,withheld_in_countries:array<string>,
        contributors_enabled:boolean,default_profile:boolean,
        default_profile_image:boolean,follow_request_sent:boolean,
        profile_background_tile:boolean,
        profile_use_background_image:boolean,protected:boolean,
        is_translator:boolean,verified:boolean,
        entities:struct<url:struct<urls:array<{_ENTITY_URL}>>,
            description:struct<urls:array<{_ENTITY_URL}>>>>,
    `delete` struct<status:struct<id:bigint,user_id:bigint>>,
    `limit` struct<track:bigint>,
    scrub_geo struct<user_id:bigint,up_to_status_id:bigint>,
    warning struct<code:string,message:string>
"""
CORRUPT = "_corrupt_record"
