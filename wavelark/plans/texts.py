"""Queries on lines, names, texts and tokens. Inputs are varied by id where the tables hold one kind only, so that every case occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import series as R
from ..sources import files
from .registry import query

OBJECTS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"delete": {"id": 1}}' WHEN 1 THEN '{"limit": {"track": 3}}' WHEN 2 THEN '{"text": "x", "warning": {}}'
  WHEN 3 THEN '{"warning": {"code": "c"}}' WHEN 4 THEN ' 2F ' WHEN 5 THEN '' WHEN 6 THEN '{"scrub_geo": {}, "text": "y"}' ELSE props END AS line FROM events"""


@query(f"""SELECT event_id, CASE WHEN regexp_full_match(trim(line), '[0-9a-fA-F]*') THEN 'nothing' WHEN json_extract(line, '$.delete') IS NOT NULL THEN 'delete'
  WHEN json_extract(line, '$.limit') IS NOT NULL THEN 'limit' WHEN json_extract(line, '$.scrub_geo') IS NOT NULL THEN 'scrub_geo'
  WHEN json_extract(line, '$.text') IS NOT NULL THEN 'text' WHEN json_extract(line, '$.warning') IS NOT NULL THEN 'warning' ELSE 'unknown' END AS kind
  FROM (SELECT event_id, CASE WHEN regexp_full_match(trim(line), '[0-9a-fA-F]*') THEN '1' ELSE line END AS line, line AS raw FROM ({OBJECTS})) x""")
def json_classify(t):
    line = F.expr("""CASE event_id % 8 WHEN 0 THEN '{"delete": {"id": 1}}' WHEN 1 THEN '{"limit": {"track": 3}}' WHEN 2 THEN '{"text": "x", "warning": {}}'
      WHEN 3 THEN '{"warning": {"code": "c"}}' WHEN 4 THEN ' 2F ' WHEN 5 THEN '' WHEN 6 THEN '{"scrub_geo": {}, "text": "y"}' ELSE props END""")
    return t.events.select("event_id", files.classify(line).alias("kind"))


LINE = """CASE event_id % 6 WHEN 0 THEN upper(event_type) ELSE event_type END || ' ' || CASE event_id % 5 WHEN 0 THEN 'File:' ELSE 'P_' END || user_id
  || CASE event_id % 7 WHEN 0 THEN ' 1 x' WHEN 1 THEN ' 1  2' ELSE ' 1 ' || event_id END"""


@query(f"""SELECT event_type AS project, user_id, count(*) AS n FROM events
  WHERE regexp_full_match({LINE}, '[a-z.]+ [-A-Za-z0-9_~!*();@,./%]+ [0-9]+ [0-9]+') GROUP BY ALL""")
def page_line_filter(t):
    return t.events.where(F.expr(LINE).rlike(files.PAGE_LINE)).groupBy(F.col("event_type").alias("project"), "user_id").agg(F.count("*").alias("n"))


URL = "url || CASE page_id % 3 WHEN 0 THEN '/L%C3%A1tra_%28x%29+y' WHEN 1 THEN '?q=a%20b*' ELSE '' END"


@query(f"""SELECT page_id, replace(url_decode(replace(u, '+', '%2B')), '_', ' ') AS decoded,
  replace(url_encode(replace(replace(url_decode(replace(u, '+', '%2B')), '_', ' '), ' ', '_')), '%2F', '/') AS encoded FROM (SELECT page_id, {URL} AS u FROM pages)""")
def url_canonical(t):
    u = F.expr(URL)
    return t.pages.select("page_id", S.url_decode(u).alias("decoded"), S.url_encode(u).alias("encoded"))


CLEAN = "CASE WHEN turn % 4 = 0 THEN 'null' WHEN turn % 4 = 1 THEN text || ' &amp; &lt;b&gt; &eacute;&#233; ' || chr(9) || chr(10) || 'x' ELSE text END"


@query(f"""SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(replace(nullif({CLEAN}, 'null'), '&lt;', '<'), '&gt;', '>'), '&eacute;', 'é'), '&#233;', 'é'), '&amp;', '&'),
  '[\\s\\x00]+', ' ', 'g') AS text FROM conversations""")
def text_clean(t):
    return t.conversations.select("conv_id", "turn", S.text_clean(F.expr(CLEAN)).alias("text"))


TWEET = "CASE conv_id % 3 WHEN 0 THEN 'RT @x: ' || text WHEN 1 THEN 'rt' || text ELSE text END"


@query(f"SELECT conv_id, turn FROM conversations WHERE trim(lower(substr({TWEET}, 1, 3))) <> 'rt'")
def retweet_filter(t):
    return t.conversations.where(F.trim(F.lower(F.substring(F.expr(TWEET), 1, 3))) != "rt").select("conv_id", "turn")


@query("""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS k, count(*) OVER () AS total FROM c WHERE n >= 5) SELECT word, n FROM r WHERE k > ceil(total * 0.01)""")
def token_trim(t):
    words = t.conversations.select(F.explode(S.tokens_space(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return R.trim_head(words, "word", "n", 0.01)


SCRIPTS = "text || CASE doc_id % 4 WHEN 0 THEN ' 日本語テスト' WHEN 1 THEN ' Ελλάδα' WHEN 2 THEN ' Москва' ELSE '' END"


@query(f"""SELECT doc_id, len(list_filter(string_split_regex(lower(c), '\\s+'), lambda x: x <> '')) AS n_space, NOT regexp_matches(c, '[^\\x{{00}}-\\x{{FF}}]') AS latin,
  regexp_matches(c, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FBF}}]') AS japanese, regexp_matches(c, '\\p{{Greek}}') AS greek FROM (SELECT doc_id, {SCRIPTS} AS c FROM documents)""")
def tokenisers(t):
    c = F.expr(SCRIPTS)
    return t.documents.select("doc_id", F.size(S.tokens_space(c)).alias("n_space"), S.is_latin(c).alias("latin"), S.is_japanese(c).alias("japanese"), c.rlike(r"\p{IsGreek}").alias("greek"))


@query(f"""SELECT doc_id, lower(t) AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({SCRIPTS}, '(\\p{{Latin}}+|\\p{{Greek}}+|\\p{{Cyrillic}}+|\\p{{Han}}+|\\p{{Katakana}}+)')) AS t
  FROM documents WHERE regexp_matches({SCRIPTS}, '[\\x{{370}}-\\x{{4FF}}\\x{{3040}}-\\x{{9FBF}}]')) WHERE regexp_matches(t, '[^\\x{{00}}-\\x{{24F}}]') GROUP BY ALL""")
def script_tokens(t):
    """Runs of one script; only those of other than Latin script, whose letters both engines class alike."""
    # texts without such a letter have no such run; the lengths tell plain ones faster
    other = lambda c: (F.octet_length(c) > F.length(c)) & c.rlike(r"[^\x{00}-\x{24F}]")
    rows = t.documents.where(other(F.expr(SCRIPTS))).select("doc_id", F.explode(S.runs_script(F.expr(SCRIPTS))).alias("run")).where(other(F.col("run")))
    return rows.groupBy("doc_id", F.lower("run").alias("token")).agg(F.count("*").alias("n"))


@query(f"""SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(c, '\\p{{Han}}') THEN 'Han' WHEN regexp_matches(c, '\\p{{Greek}}') THEN 'Greek'
  WHEN regexp_matches(c, '\\p{{Cyrillic}}') THEN 'Cyrillic' WHEN regexp_matches(c, '\\p{{Katakana}}') THEN 'Katakana' WHEN regexp_matches(c, '\\p{{Latin}}') THEN 'Latin'
  ELSE 'Common' END AS script FROM (SELECT unnest(string_split(right({SCRIPTS}, 8), '')) AS c FROM documents)) GROUP BY 1""")
def script_lookup(t):
    """Scripts of the last eight characters of every text."""
    chars = t.documents.select(F.explode(F.split(F.expr(f"right({SCRIPTS}, 8)"), "")).alias("c"))
    return chars.groupBy(S.script_of(F.col("c")).alias("script")).agg(F.count("*").alias("n"))


FIELDS = "SELECT conv_id, turn, 'tx' AS field, text AS body FROM conversations UNION ALL SELECT conv_id, turn, 'ds', role FROM conversations"


@query(f"""SELECT conv_id, turn, field || ' ' || token AS token, count(*) AS n FROM (SELECT conv_id, turn, field, unnest(string_split_regex(lower(body), '\\s+')) AS token FROM ({FIELDS}))
  WHERE token <> '' GROUP BY ALL""")
def field_tokens(t):
    rows = t.conversations.select("conv_id", "turn", F.explode(S.field_tokens({"tx": F.col("text"), "ds": F.col("role")})).alias("token"))
    return rows.groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') AS stem, CASE WHEN regexp_full_match(label, '[-+]?[0-9]+') THEN try_cast(label AS BIGINT) END AS whole, try_cast(label AS DOUBLE) AS number, n % 2 = 0 AS even,
  CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'k' ELSE ((n + 50000) // 1000000) || '.' || ((n + 50000) // 100000 % 10) || 'M' END AS si
  FROM (SELECT page_id, url, length(html) AS n, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN page_id || '.5' ELSE 'x' || page_id END AS label FROM pages)""")
def text_helpers(t):
    n, label = F.length("html"), F.expr("CASE page_id % 3 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN page_id || '.5' ELSE 'x' || page_id END")
    whole, number = S.int_or_float(label)
    return t.pages.select("page_id", S.without_ext(F.col("url")).alias("stem"), whole.alias("whole"), number.alias("number"), (n % 2 == 0).alias("even"), S.si_text(n).alias("si"))


@query("""SELECT o_orderpriority, k, max(v) AS v FROM (SELECT o_orderpriority, unnest(['orders', 'pending']) AS k, unnest([count(*), count(*) FILTER (o_orderstatus = 'P')]) AS v FROM orders GROUP BY 1)
  GROUP BY ALL""")
def options_map(t):
    """Values read back from text of the form a=1,b=2."""
    s = t.orders.groupBy("o_orderpriority").agg(F.format_string("orders=%d,pending=%d", F.count("*"), F.count_if(F.col("o_orderstatus") == "P")).alias("s"))
    return s.select("o_orderpriority", F.explode(S.options(F.col("s"))).alias("k", "v")).withColumn("v", F.col("v").cast("long"))


@query("""SELECT kind, a, b, na = 1 AS unique_a, nb = 1 AS unique_b FROM (SELECT *, count(DISTINCT b) OVER (PARTITION BY kind, a) AS na, count(DISTINCT a) OVER (PARTITION BY kind, b) AS nb FROM (
  SELECT 'key' AS kind, n_nationkey::VARCHAR AS a, n_name AS b FROM nation UNION SELECT 'region', n_regionkey::VARCHAR, n_name FROM nation UNION SELECT 'type', p_brand, p_type FROM part))""")
def mapping_unique(t):
    key = t.nation.select(F.lit("key").alias("kind"), F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b"))
    region = t.nation.select(F.lit("region"), F.col("n_regionkey").cast("string"), "n_name")
    return R.mapping(key.union(region).union(t.part.select(F.lit("type"), "p_brand", "p_type")), ["kind"], "a", "b")


@query("""SELECT size, string_agg(r_name, '+' ORDER BY r_name) AS names FROM (SELECT bits, bit_count(bits) AS size, r_name FROM (SELECT unnest(range(1, 32)) AS bits) s,
  (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region) r WHERE (bits >> i) & 1 = 1) GROUP BY bits, size""")
def combinations(t):
    """All combinations of one to five regions."""
    return R.combinations(t.region.select(F.col("r_name").alias("name")), "name", 5).select(F.size("names").cast("tinyint").alias("size"), F.concat_ws("+", "names").alias("names"))


@query("SELECT n.n_nationkey, x.h AS horizon, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 4, 8])::INT AS h) x")
def factor_product(t):
    h = t.spark.createDataFrame([(k,) for k in (1, 2, 4, 8)], "horizon int")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(h)).select("n_nationkey", "horizon", "r_name")
