"""Scalar functions, text and guards over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules, text
from convoy.operators import access, events, exports, retrieval
from convoy.plans.registered import LEVEL, RANK, query, up
from convoy.plans.views import severity
from convoy.streaming import jobs

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains([" + STOP + "], t))"
REDACT = "text"
for _label, _pattern in text.REDACTIONS:
    REDACT = f"regexp_replace({REDACT}, '{_pattern}', '[{_label}_REDACTED]', 'g')"


@query("severity_for", f"SELECT seq, kind, {severity('kind', 'v')} AS severity FROM (SELECT seq, kind, CASE WHEN seq % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM {{telemetry}})")
def severity_for(t):
    value = F.when(F.col("seq") % 97 == 0, float("nan")).otherwise(F.col("value"))
    return t.telemetry.select("seq", "kind", rules.severity(F.col("kind"), value).alias("severity"))


@query("hos_level", "SELECT driver_id, CASE WHEN hos_remaining_minutes <= 40 THEN 'critical' WHEN hos_remaining_minutes <= 60 THEN 'warning' END AS level, concat(CAST(hos_remaining_minutes // 60 AS STRING), 'h', lpad(CAST(hos_remaining_minutes % 60 AS STRING), 2, '0')) AS left_over FROM {drivers}")
def hos_level(t):
    m = F.col("hos_remaining_minutes")
    return t.drivers.select("driver_id", rules.hos_level(m).alias("level"), rules.format_hours(m).alias("left_over"))


@query("worst_severity", f"SELECT tenant_id, driver_id, {LEVEL.format('max(' + RANK.format('severity') + ')')} AS worst FROM {{telemetry}} GROUP BY tenant_id, driver_id")
def worst_severity(t):
    return t.telemetry.groupBy("tenant_id", "driver_id").agg(rules.level(F.max(rules.rank(F.col("severity")))).alias("worst"))


@query("shard_distribution", "SELECT shard, count(*) AS n FROM (SELECT CAST(('0x' || substr(sha256(driver_id), 1, 8))::BIGINT % 16 AS INT) AS shard FROM {telemetry}) GROUP BY shard")
def shard_distribution(t):
    return t.telemetry.groupBy(rules.shard_of(F.col("driver_id"), 16).alias("shard")).agg(F.count("*").alias("n"))


@query("token_estimate", "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM {conversations}")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


@query("content_hash", "SELECT seq, substr(sha256(provider || '|' || source_ref || '|' || CAST(observed_s AS STRING)), 1, 24) AS id FROM {telemetry}")
def content_hash(t):
    return t.telemetry.select("seq", text.content_id(F.col("provider"), F.col("source_ref"), F.col("observed_s")).alias("id"))


@query("tokenize", f"SELECT doc_id, CAST(len(w) AS INT) AS n, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM {{documents}})")
def tokenize(t):
    words = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("digest"))


@query("embed_bow", f"""
WITH w AS (SELECT item_id, CAST(('0x' || substr(sha256(unnest({TOKENS.format('text')})), 1, 4))::INT % 256 AS INT) AS bucket FROM {{benchmark}}),
c AS (SELECT item_id, bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, bucket, {up("n / sqrt(sum(n * n) OVER (PARTITION BY item_id))", 6)} AS weight FROM c""")
def embed_bow(t):
    v = retrieval.word_vectors(t.benchmark, ["item_id"], "text")
    return v.select("item_id", "bucket", rules.half_up(F.col("weight"), 6).alias("weight"))


@query("cosine_topk", f"""
WITH q AS (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0),
s AS (SELECT vec_id, {up("list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))", 6)} AS score FROM {{embeddings}}, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = t.embeddings.crossJoin(F.broadcast(one)).select("vec_id", rules.half_up(text.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query("hybrid_topk", f"""
WITH c AS (SELECT lang AS tenant, doc_id AS chunk_id, {TOKENS.format('text')} AS w FROM {{documents}}),
q AS (SELECT l.tenant, item_id AS question_id, {TOKENS.format('text')} AS w FROM {{benchmark}}, (SELECT DISTINCT lang AS tenant FROM {{documents}}) l),
cb AS (SELECT tenant, chunk_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY tenant, chunk_id)) AS w FROM (SELECT tenant, chunk_id, ('0x' || substr(sha256(t), 1, 4))::INT % 256 AS bucket, count(*) AS n FROM (SELECT tenant, chunk_id, unnest(w) AS t FROM c) GROUP BY ALL)),
qb AS (SELECT tenant, question_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY tenant, question_id)) AS w FROM (SELECT tenant, question_id, ('0x' || substr(sha256(t), 1, 4))::INT % 256 AS bucket, count(*) AS n FROM (SELECT tenant, question_id, unnest(w) AS t FROM q) GROUP BY ALL)),
cs AS (SELECT tenant, question_id, chunk_id, sum(qb.w * cb.w) AS cosine FROM qb JOIN cb USING (tenant, bucket) GROUP BY ALL),
sh AS (SELECT tenant, question_id, chunk_id, count(*) AS shared FROM (SELECT DISTINCT tenant, question_id, unnest(w) AS t FROM q) JOIN (SELECT DISTINCT tenant, chunk_id, unnest(w) AS t FROM c) USING (tenant, t) GROUP BY ALL),
sc AS (SELECT cs.*, 0.7::DOUBLE * cosine + 0.3::DOUBLE * coalesce(shared, 0) / greatest(len(list_distinct(w)), 1) AS score FROM cs LEFT JOIN sh USING (tenant, question_id, chunk_id) JOIN q USING (tenant, question_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant, question_id ORDER BY floor(score * 1e9 + 0.5) DESC, chunk_id) AS rank FROM sc)
SELECT tenant, question_id, CAST(rank AS INT) AS rank, chunk_id, {up("score", 6)} AS score FROM r WHERE rank <= 3""")
def hybrid_topk(t):
    docs = t.documents.select(F.col("lang").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), "text")
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), "text").crossJoin(docs.select("tenant_id").distinct())
    found = retrieval.retrieve_many(docs, asked)
    return found.select(F.col("tenant_id").alias("tenant"), "question_id", "rank", "chunk_id", rules.half_up(F.col("score"), 6).alias("score"))


_WHITE = "[ \\t\\n\\x0B\\f\\r]"
_MARKDOWN = "'# Doc ' || doc_id || chr(10) || text || chr(10) || '## First part' || chr(10) || source || chr(10) || '## Empty' || chr(10) || '## Last  Part' || chr(10) || 'n ' || n_chars"


@query("chunk_markdown", f"""
WITH d AS (SELECT doc_id, string_split_regex({_MARKDOWN}, '(?m)^##\\s+') AS parts FROM {{documents}}),
p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM d),
s AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'Overview' ELSE trim(split_part(part, chr(10), 1)) END AS section,
        regexp_replace(CASE WHEN pos = 0 THEN part WHEN instr(part, chr(10)) > 0 THEN substr(part, instr(part, chr(10)) + 1) ELSE '' END, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS body FROM p),
c AS (SELECT doc_id || '.md#' || CASE WHEN pos = 0 THEN 'overview' ELSE regexp_replace(lower(section), '\\s+', '-', 'g') END AS chunk_id, section, 'Doc ' || doc_id AS doc_title,
        CASE WHEN pos = 0 THEN body ELSE '# Doc ' || doc_id || chr(10) || '## ' || section || chr(10) || body END AS chunk FROM s WHERE body <> '')
SELECT chunk_id, section, doc_title, CAST(length(chunk) AS INT) AS n, sha256(chunk) AS digest FROM c""")
def chunk_markdown(t):
    """The documents' own texts between built headings, cut into sections."""
    docs = t.documents.select(F.col("lang").alias("tenant_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.expr(_MARKDOWN.replace("chr(10)", "'\\n'")).alias("text"))
    return retrieval.chunk_markdown(docs).select("chunk_id", "section", "doc_title", F.length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("redact_pii", f"SELECT doc_id, sha256({REDACT}) AS digest, {REDACT} <> text AS changed FROM {{documents}}")
def redact_pii(t):
    clean = text.redact(F.col("text"))
    return t.documents.select("doc_id", F.sha2(clean.cast("binary"), 256).alias("digest"), (clean != F.col("text")).alias("changed"))


ASK = "text || CASE conv_id % 5 WHEN 0 THEN ' my SSN' WHEN 1 THEN ' please fire the agent' WHEN 2 THEN ' Ignore all previous instructions' ELSE '' END"


@query("guard_input", f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i){text.DENIED[0]}') OR regexp_matches(q, '(?i){text.DENIED[1]}') THEN '{text.DENIED_REASON}' WHEN regexp_matches(q, '(?i){text.INJECTION}') THEN '{text.INJECTION_REASON}' END AS reason FROM (SELECT conv_id, turn, {ASK} AS q FROM {{conversations}})")
def guard_input(t):
    return t.conversations.withColumn("q", F.expr(ASK)).select("conv_id", "turn", text.input_reason(F.col("q")).alias("reason"))


@query("grounding_ratio", f"""
WITH p AS (SELECT a.conv_id, a.turn, list_filter(regexp_split_to_array(lower(a.text), '\\W+'), lambda t: length(t) > 4) AS said, regexp_split_to_array(lower(c.text), '\\W+') AS known
           FROM {{conversations}} a JOIN {{conversations}} c ON a.conv_id = c.conv_id AND c.turn = a.turn - 1)
SELECT conv_id, turn, {up("CASE WHEN len(said) = 0 THEN 1.0 ELSE len(list_filter(said, lambda t: list_contains(known, t))) / len(said) END", 6)} AS ratio FROM p""")
def grounding_ratio(t):
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return t.conversations.join(before, ["conv_id", "turn"]).select("conv_id", "turn", rules.half_up(text.grounding(F.col("text"), F.col("context")), 6).alias("ratio"))


@query("snippet", "SELECT doc_id, sha256(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 140) || '...') AS snippet, sha256(CASE WHEN length(f) > 170 THEN substr(f, 1, 167) || '...' ELSE f END) AS line FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM {documents})")
def snippet(t):
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return t.documents.select("doc_id", digest(text.snippet(F.col("text"))).alias("snippet"), digest(text.one_line(F.col("text"))).alias("line"))


NAMES = "text || CASE conv_id % 6 WHEN 0 THEN ' DRV-1234 in Austin' WHEN 1 THEN ' near Dallas and Austin' WHEN 2 THEN ' at phoenix' WHEN 3 THEN ' SOURCE dal#7 ok' ELSE '' END"


@query("extract_entity", f"SELECT conv_id, turn, coalesce(nullif(lower(regexp_extract(q, '(?i)\\b(drv-\\d{{4}})\\b', 1)), ''), {'CASE ' + ' '.join(f'''WHEN contains(lower(q), '{k}') THEN '{v}' ''' for k, v in text.PLACES.items()) + 'END'}) AS driver_id, coalesce(nullif(regexp_extract(q, 'SOURCE (\\S+)', 1), ''), 'telemetry') AS source FROM (SELECT conv_id, turn, {NAMES} AS q FROM {{conversations}})")
def extract_entity(t):
    q = t.conversations.withColumn("q", F.expr(NAMES))
    return q.select("conv_id", "turn", text.named_driver(F.col("q")).alias("driver_id"), text.source_of(F.col("q")).alias("source"))


@query("incident_title", "SELECT k AS kind, CASE k WHEN 'panic' THEN 'PANIC ALERT' WHEN 'hos-risk' THEN 'Hours-of-service risk' WHEN 'harsh-braking' THEN 'Harsh braking' WHEN 'prolonged-idle' THEN 'Prolonged idle' WHEN 'route-deviation' THEN 'Route deviation' ELSE k END AS title, count(*) AS n FROM (SELECT CASE kind WHEN 'idle' THEN 'prolonged-idle' WHEN 'harsh-brake' THEN 'harsh-braking' WHEN 'hos-remaining' THEN 'hos-risk' WHEN 'route-adherence' THEN 'route-deviation' ELSE kind END AS k FROM {telemetry}) GROUP BY ALL")
def incident_title(t):
    from convoy.schema import RULES

    names = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(names, F.col("kind")), F.col("kind"))
    return t.telemetry.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select("kind", rules.title_of(F.col("kind")).alias("title"), "n")


@query("hive_partition", "SELECT strftime(observed_at, '%Y-%m-%d') AS dt, strftime(observed_at, '%H') AS hh, count(*) AS n FROM {telemetry} GROUP BY ALL")
def hive_partition(t):
    return t.telemetry.select(*[c.alias(n) for n, c in text.date_hour(F.col("observed_at")).items()]).groupBy("dt", "hh").agg(F.count("*").alias("n"))


@query("b64url", "SELECT page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS coded, url AS back FROM {pages}")
def b64url(t):
    coded = text.b64url(F.col("url"))
    return t.pages.select("page_id", coded.alias("coded"), text.from_b64url(coded).alias("back"))


@query("json_props", "SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS INT) AS k FROM {events}) GROUP BY k")
def json_props(t):
    return t.events.select(F.from_json("props", "k INT").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("severity_colour", "SELECT severity, CASE severity WHEN 'critical' THEN '#d7263d' WHEN 'warning' THEN '#f4a259' WHEN 'info' THEN '#4c86c8' ELSE '#3fa66b' END AS colour, count(*) AS n FROM {incidents} GROUP BY ALL")
def severity_colour(t):
    return t.incidents.groupBy("severity").agg(F.count("*").alias("n")).select("severity", exports.severity_colour(F.col("severity")).alias("colour"), "n")


@query("coord_valid", "SELECT driver_id, CASE WHEN isnan(x) THEN false ELSE coalesce(x BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) END AS valid FROM (SELECT driver_id, CASE CAST(driver_id AS BIGINT) % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN lon - 100 WHEN 2 THEN NULL ELSE lon END AS x, lat FROM {drivers})")
def coord_valid(t):
    from convoy.functions.spatial import valid_point

    n = F.col("driver_id").cast("bigint") % 5
    x = F.when(n == 0, float("nan")).when(n == 1, F.col("lon") - 100).when(n == 2, F.lit(None).cast("double")).otherwise(F.col("lon"))
    return t.drivers.select("driver_id", valid_point(x, F.col("lat")).alias("valid"))


@query("clamp", "SELECT o_orderkey, least(greatest(o_orderkey, 1), 100) AS page, least(greatest(o_totalprice / 100, 0.1::DOUBLE), 2000.0::DOUBLE) AS radius FROM {orders}")
def clamp(t):
    return t.orders.select("o_orderkey", F.least(F.greatest("o_orderkey", F.lit(1)), F.lit(100)).alias("page"), rules.clamp(F.col("o_totalprice") / 100, 0.1, 2000.0).alias("radius"))


GROUPS = "CASE c_custkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE NULL END"
_LISTS = (["admin", "other"], ["dispatcher"], ["nobody"], ["safety", "viewer"])
GROUPS_SPARK = GROUPS.format(*[f"array({', '.join(repr(x) for x in g)})" for g in _LISTS])
GROUPS_DUCK = GROUPS.format(*[repr(g) for g in _LISTS])


@query("roles_map", f"""
WITH g AS (SELECT c_custkey, list_filter(coalesce({GROUPS_DUCK}, []), lambda x: list_contains(['admin', 'dispatcher', 'safety', 'viewer'], x)) AS r FROM {{customer}}),
f AS (SELECT c_custkey, CASE WHEN len(r) = 0 THEN ['viewer'] ELSE r END AS roles FROM g)
SELECT c_custkey, array_to_string(roles, ',') AS roles, list_has_any(roles, ['admin', 'dispatcher']) AS may_write, CASE WHEN list_has_any(roles, ['admin', 'safety']) THEN 'tenant' WHEN c_custkey % 2 = 0 THEN 'district' ELSE 'driver' END AS scope FROM f""")
def roles_map(t):
    rows = t.customer.select("c_custkey", access.roles_of(F.expr(GROUPS_SPARK)).alias("r"))
    district = F.when(F.col("c_custkey") % 2 == 0, "dal")
    return rows.select("c_custkey", F.array_join("r", ",").alias("roles"), access.may_use(F.col("r"), F.lit("openIncident")).alias("may_write"), access.scope_of(F.col("r"), district).alias("scope"))


@query("claim_reject_reason", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'wrong issuer' WHEN o_orderkey % 5 = 0 THEN 'wrong client' WHEN o_orderkey % 11 = 0 THEN 'wrong token use' WHEN o_custkey <= 50 THEN 'expired' WHEN o_custkey > 110 + 60 THEN 'issued in the future' WHEN o_orderkey % 13 = 0 THEN 'no tenant' END AS reason FROM {orders}")
def claim_reject_reason(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    claims = {"iss": F.when(k % 7 == 0, "x").otherwise("me"), "client": F.when(k % 5 == 0, F.lit(None)).otherwise("app"), "use": F.when(k % 11 == 0, "id").otherwise("access"), "exp": c + 60, "iat": c, "tenant": F.when(k % 13 == 0, "").otherwise("t")}
    return t.orders.select("o_orderkey", access.claim_reject_reason(claims, "me", "app", F.lit(110)).alias("reason"))


@query("email_domain_left", "SELECT c_custkey, m.tenant_id, m.district FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acme-freight.com' WHEN 1 THEN 'northstar-logistics.com' WHEN 2 THEN '' ELSE 'nowhere.org' END AS d FROM {customer}) LEFT JOIN (VALUES ('acme-freight.com', 'acme-freight', 'dal'), ('northstar-logistics.com', 'northstar-logistics', NULL)) m(dom, tenant_id, district) ON d = dom")
def email_domain_left(t):
    from convoy.sources.registry import memberships, with_membership

    n = F.col("c_custkey") % 4
    mail = F.when(n == 0, "A@Acme-Freight.com").when(n == 1, "b@northstar-logistics.com").when(n == 2, "no address").otherwise("c@nowhere.org")
    return with_membership(t.customer.select("c_custkey", mail.alias("email")), F.broadcast(memberships(t.spark))).select("c_custkey", "tenant_id", "district")


@query("event_pattern", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_type IN ('click', 'error') THEN 'ui' END, CASE WHEN event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS INT) IN (1, 2, 3) THEN 'deal' END, CASE WHEN CAST(json_extract(props, '$.k') AS INT) = 50 THEN 'fifty' END], lambda x: x IS NOT NULL), ',') AS rules FROM {events}")
def event_pattern(t):
    rows = t.events.select("event_id", F.lit("board").alias("source"), F.col("event_type").alias("detail_type"), F.from_json("props", "k INT").alias("detail"))
    routes = {"ui": {"detail-type": ["click", "error"]}, "deal": {"source": ["board"], "detail-type": ["purchase"], "detail": {"k": [1, 2, 3]}}, "fifty": {"detail": {"k": [50]}}}
    return events.route(rows, routes).select("event_id", F.array_join("matched_rules", ",").alias("rules"))


@query("sub_filter", "SELECT incident_id, sub FROM {incidents}, (VALUES (1, '3', NULL), (2, NULL, 'open'), (3, '7', 'open'), (4, NULL, NULL)) s(sub, d, st) WHERE (d IS NULL OR list_contains(driver_ids, d)) AND (st IS NULL OR status = st)")
def sub_filter(t):
    subs = t.spark.createDataFrame([(1, "3", None), (2, None, "open"), (3, "7", "open"), (4, None, None)], "sub int, want_driver_ids string, want_status string")
    return events.fan_out(t.incidents, subs, {"driver_ids": True, "status": False}).select("incident_id", "sub")


@query("sessions", "WITH g AS (SELECT *, CASE WHEN observed_s - lag(observed_s) OVER w <= 120 THEN 0 ELSE 1 END AS new FROM {telemetry} WINDOW w AS (PARTITION BY tenant_id, driver_id ORDER BY observed_s, seq)), s AS (SELECT *, sum(new) OVER (PARTITION BY tenant_id, driver_id ORDER BY observed_s, seq) AS k FROM g) SELECT driver_id, min(observed_s) AS begins, max(observed_s) AS last, count(*) AS n FROM s GROUP BY tenant_id, driver_id, k")
def sessions(t):
    readings = t.telemetry.withColumn("observed_at", F.timestamp_seconds("observed_s"))
    runs = jobs.sessions(readings, "120 seconds")
    return runs.select("driver_id", F.unix_seconds("begins").alias("begins"), (F.unix_seconds("ends") - 120).alias("last"), "n")


@query("severity_cube", "SELECT district_id, kind, severity, count(*) AS n FROM {telemetry} GROUP BY CUBE (district_id, kind, severity)")
def severity_cube(t):
    return t.telemetry.cube("district_id", "kind", "severity").agg(F.count("*").alias("n"))
