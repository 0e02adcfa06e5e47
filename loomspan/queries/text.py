"""Queries of document search, document preparation, conversations, logs and evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..plans import values
from ..plans.views import CATALOG
from ..retrieval import documents, search
from ..sources import copies, store
from ..sources.tables import table as _t
from ..sources.versions import scratch


QUERY = "the thing of another and with these"
GERMAN = "der schen und nicht ein"
VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]


def bm25_topk(spark, sf):
    return search.bm25(_t(spark, sf, "documents"), QUERY, 20)


def bm25_filtered(spark, sf):
    """The filter holds before anything is counted."""
    return search.bm25(_t(spark, sf, "documents"), GERMAN, 10, where=F.col("lang") == "de")


def _bm25(where: str, k: int, query: str = QUERY) -> str:
    terms = search.query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    return f"WITH b AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[ঀ-৿]+') AS t FROM documents {where}), c AS (SELECT doc_id, len(t) AS len, {tf} FROM b), s AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM c) SELECT doc_id, round({score}, 6) AS score FROM c CROSS JOIN s WHERE round({score}, 6) > 0 ORDER BY score DESC, doc_id LIMIT {k}"


def cosine_topk(spark, sf):
    return search.nearest(_t(spark, sf, "embeddings"), VECTOR, 20)


LITERAL = "[" + ", ".join(f"CAST({v} AS double)" for v in VECTOR) + "]"
COSINE = f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS double[]), {LITERAL}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20"


def rrf_merge(spark, sf):
    words = bm25_topk(spark, sf)
    near = search.nearest(_t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), VECTOR, 20, id_col="doc_id")
    return search.fused(words, near, 8)


RRF = f"WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25('', 20)}) a), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({COSINE}) b), f AS (SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score, min(CASE WHEN l = 0 THEN r END) AS fr FROM (SELECT *, 0 AS l FROM w UNION ALL SELECT *, 1 AS l FROM v) u GROUP BY doc_id) SELECT doc_id, score FROM f ORDER BY score DESC, fr NULLS LAST, doc_id LIMIT 8"


def hybrid_retrieve(spark, sf):
    """Scope, both searches, fusion, final six; documents carry the vector of equal number, or none."""
    chunks = _t(spark, sf, "documents").join(_t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return search.retrieve(chunks, QUERY, VECTOR, F.col("source").isin("src1", "src2", "src3", "src4", "src5"))


def hash_dedupe(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def embed_anti_cache(spark, sf):
    """Which distinct texts a cache that holds every third document's hash still lacks."""
    d = _t(spark, sf, "documents")
    cache = d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash"), F.lit("m1").alias("model")).distinct()
    return documents.to_embed(d.select("text"), cache, "m1").select("hash", F.length("text").alias("n_chars"))


def cache_prune(spark, sf):
    d = _t(spark, sf, "documents")
    cache = d.select(F.sha2("text", 256).alias("hash"), F.lit("m1").alias("model")).distinct()
    return documents.pruned(cache, d.where("lang = 'en'").select("text")).select("hash")


def change_detection(spark, sf):
    d = _t(spark, sf, "documents")
    before = d.where("doc_id >= 20").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("hash"))
    return documents.changes(d.where("doc_id % 11 != 0"), before)


def chunk_documents(spark, sf):
    return documents.chunks(_t(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def repeated_lines(spark, sf):
    return documents.repeated_lines(documents.pages_of(_t(spark, sf, "documents"), 5))


REPEATED = """
WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT doc_id, pos // 5 AS page, pos % 5 AS line, text FROM p),
e AS (SELECT *, max(line) OVER (PARTITION BY doc_id, page) AS last FROM l),
s AS (SELECT doc_id, regexp_replace(trim(text), '[0-9]', '#', 'g') AS shape, count(DISTINCT page) AS "on" FROM e WHERE (line < 3 OR line > last - 3) AND trim(text) <> '' GROUP BY 1, 2),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id)
SELECT s.doc_id, shape, "on", pages FROM s INNER JOIN n USING (doc_id) WHERE pages >= 3 AND "on" >= 0.5 * pages
"""


def contents_pages(spark, sf):
    """Documents of which every third has a table of contents before its text."""
    contents = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.concat(F.lit("Heading "), k.cast("string"), F.lit(" ........ "), k.cast("string"))), "\n")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(contents, F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    return documents.contents_pages(documents.pages_of(_t(spark, sf, "documents").select("doc_id", text.alias("text")), 10))


CONTENTS = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_transform(range(1, 9), lambda k: 'Heading ' || k || ' ........ ' || k), chr(10)) || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d)
SELECT doc_id, pos // 10 AS page, count(*) FILTER (WHERE regexp_matches(text, '(\.[ ]?){4,}[ ]*([0-9]+|[ivxlcdmIVXLCDM]+)[ ]*$')) AS dotted, count(*) AS lines
FROM p WHERE trim(text) <> '' GROUP BY 1, 2 HAVING dotted >= 5 AND dotted * 2 >= count(*)
"""


def superseded(spark, sf):
    t = _t(spark, sf, "pages").select(F.col("url").alias("source"), F.concat(F.lit("Manual "), F.col("page_id") % 20, F.lit(" Rev "), F.floor(F.col("page_id") / 20) + 1, F.lit("."), F.col("page_id") % 3).alias("title"))
    return documents.superseded(t)


SUPERSEDED = "WITH t AS (SELECT url AS source, page_id % 20 AS b, page_id // 20 + 1 AS major, page_id % 3 AS minor, 'Manual ' || (page_id % 20) || ' Rev ' || (page_id // 20 + 1) || '.' || (page_id % 3) AS title FROM pages) SELECT source, title FROM t WHERE EXISTS (SELECT 1 FROM t n WHERE n.b = t.b AND (n.major > t.major OR (n.major = t.major AND n.minor > t.minor)))"


def _stores(spark, sf):
    d = _t(spark, sf, "documents")
    return {"chunk": d.where("doc_id % 5 != 0").select(F.col("doc_id").alias("chunk_id")), "keyword": d.where("doc_id % 7 != 0").select(F.col("doc_id").alias("chunk_id")), "vector": d.where("doc_id % 5 != 1").select(F.col("doc_id").alias("chunk_id"))}


def index_consistency(spark, sf):
    return documents.inconsistent(_stores(spark, sf))


_HAS = {"chunk": "doc_id % 5 <> 0", "keyword": "doc_id % 7 <> 0", "vector": "doc_id % 5 <> 1"}
CONSISTENT = " UNION ALL ".join(f"SELECT '{a}' AS have, '{b}' AS lack, doc_id AS chunk_id FROM documents WHERE {_HAS[a]} AND NOT ({_HAS[b]})" for a in _HAS for b in _HAS if a != b)


def duplicate_names(spark, sf):
    f = _t(spark, sf, "documents").select(F.concat(F.lit("file"), F.col("doc_id") % 50, F.lit(".pdf")).alias("name"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 9 == 0).alias("indexed"))
    return documents.one_of_each_name(f)


def inherited_attributes(spark, sf):
    files = _t(spark, sf, "documents").select(F.concat_ws("/", F.lit("root"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    folders = spark.createDataFrame([("root", "all"), ("root/src1", "one"), ("root/src1/de", "german"), ("root/src2", "two")], "folder string, department string")
    return documents.inherited(files, folders, "department")


INHERITED = "SELECT 'root/' || source || '/' || lang || '/' || doc_id AS path, CASE WHEN source = 'src1' AND lang = 'de' THEN 'german' WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN 'two' ELSE 'all' END AS department FROM documents"


def even_sample(spark, sf):
    return documents.even_sample(_t(spark, sf, "documents").select("doc_id"), 10, "doc_id")


def value_lookup(spark, sf):
    c = _t(spark, sf, "customer")
    entries = c.select(F.lit("buyer").alias("entity"), F.concat(F.lit("Buyer House "), F.col("c_custkey").cast("string"), F.lit(" Ltd")).alias("value"), F.col("c_custkey").cast("string").alias("code"), F.lit(None).cast("string").alias("factory"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("bh"), F.col("c_custkey").cast("string"))).alias("alias"))
    questions = spark.createDataFrame([(1, "orders of buyer house 17 ltd this week"), (2, "what did BH20 order"), (3, "orders of byer house 33"), (4, "nothing of interest")], "question_id int, text string")
    return values.resolve(values.lookup(questions, entries)).select("question_id", "entity", "value", "score")


def answered_questions(spark, sf):
    """A user's turn with the assistant's next one: a self-join on the turn's number."""
    t = _t(spark, sf, "conversations")
    u, a = t.where("role = 'user'"), t.where("role = 'assistant'")
    return u.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answer_chars")), ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").alias("question_chars"), "answer_chars")


def recent_questions(spark, sf):
    """The newest questions, then each only once without regard to case and blanks; the newest spelling stays."""
    t = _t(spark, sf, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn"), "text").limit(200)
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    by = Window.partitionBy(key).orderBy(F.desc("conv_id"), F.desc("turn"), "text")
    return t.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("conv_id", "turn", F.length("text").alias("n_chars"))


def upsert_turns(spark, sf):
    t = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.lit(1).alias("stamp"))
    new = t.where("conv_id % 4 = 0").withColumn("role", F.lit("edited")).withColumn("stamp", F.lit(2))
    old = t.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max("stamp").alias("stamp"))
    return store.upserted(old, new.distinct(), ["conv_id", "turn"], "stamp").groupBy("role", "stamp").agg(F.count("*").alias("n"))


def purge_old(spark, sf):
    t = _t(spark, sf, "conversations")
    c = t.select("conv_id").distinct().select("conv_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86400).alias("updated"), (F.col("conv_id") % 6 == 0).alias("deleted"))
    return store.purged(c, t, dt.datetime(2023, 12, 15))[1].groupBy("role").agg(F.count("*").alias("n"))


PURGED = "SELECT role, count(*) AS n FROM conversations WHERE conv_id % 6 <> 0 AND 1700000000 + conv_id * 86400 >= epoch(TIMESTAMP '2023-12-15 00:00:00') GROUP BY role"


def redact_by_request(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("request_id"), F.col("event_type").alias("database"), F.col("props").alias("statement"))
    out = store.redacted(e, ["purchase"], ["statement", "database"])
    return out.groupBy(F.col("database").alias("shown")).agg(F.count("*").alias("n"))


REDACTED = "WITH e AS (SELECT event_id, user_id, event_type FROM events), b AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase') SELECT CASE WHEN b.user_id IS NOT NULL THEN '(withheld)' ELSE event_type END AS shown, count(*) AS n FROM e LEFT JOIN b USING (user_id) GROUP BY 1"


def rotated_logs(spark, sf):
    """Log files of two layouts by name, what one lacks is null."""
    e = _t(spark, sf, "events")
    a, b = e.where("event_type IN ('view', 'click')").select("ts", "user_id", "event_type"), e.where("event_type IS NULL OR event_type NOT IN ('view', 'click')").select("ts", "user_id", "value")
    return store.all_logs(a, b).select("user_id", "event_type", F.round("value", 4).alias("value"))


def latency_percentiles(spark, sf):
    """Nearest rank, without a task that holds a type's values."""
    return ranks.nearest_ranks(_t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def events_json(spark, sf):
    return _t(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls"))


def calls_today(spark, sf):
    """Calls since the provider's midnight, in its own time zone, on the newest day of the log."""
    e = _t(spark, sf, "events").select("event_type", F.from_utc_timestamp("ts", "America/Los_Angeles").alias("at"))
    newest = e.agg(F.to_date(F.max("at")).alias("day"))
    return e.join(F.broadcast(newest)).where(F.to_date("at") == F.col("day")).groupBy("event_type").agg(F.count("*").alias("n"))


CALLS = "WITH e AS (SELECT event_type, ts - INTERVAL 8 HOUR AS local_at FROM events) SELECT event_type, count(*) AS n FROM e WHERE CAST(local_at AS date) = (SELECT max(CAST(local_at AS date)) FROM e) GROUP BY event_type"


def windowed_events(spark, sf):
    from ..streaming.events import by_window

    return by_window(_t(spark, sf, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def usage_counts(spark, sf):
    """How often words name tables in questions: exploded and counted."""
    words = _t(spark, sf, "conversations").where("role = 'user'").select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


def hit_rate(spark, sf):
    """Cases (labels) whose accepted row is found by a search that keeps every other document."""
    accepted = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("case"), "doc_id")
    return documents.hit_rate(_t(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id"), accepted, ["doc_id"])


def registry_stats(spark, sf):
    """The registry over documents and pages: a document is a file, a page of the web a chunk."""
    files = _t(spark, sf, "documents").select(F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("done").alias("status"), F.ceil(F.col("n_chars") / 1000).alias("pages"), F.when(F.col("lang") == "de", F.lit(1)).alias("ocr_pages"))
    return documents.registry_stats(files, _t(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 0, "table").otherwise("text").alias("kind")))


REGISTRY = "SELECT documents, failed, pages, chunks, tables, ocr_pages FROM (SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id % 17 = 0) AS failed, CAST(sum(CAST(ceil(n_chars / 1000.0) AS bigint)) AS bigint) AS pages, count(*) FILTER (WHERE lang = 'de') AS ocr_pages FROM documents) f CROSS JOIN (SELECT count(*) AS chunks, count(*) FILTER (WHERE page_id % 4 = 0) AS tables FROM pages) c"


def recall_at_two(spark, sf):
    """Orders as cases, their parts as what two searches found in turn; parts of even size are accepted."""
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"))
    found = lines.withColumn("mode", F.lit("keyword")).unionByName(lines.where("rank > 1").select("case", "item", (F.col("rank") - 1).alias("rank"), F.lit("hybrid").alias("mode")))
    accepted = lines.join(_t(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("item")), "item").select("case", "item")
    return documents.recall_at(found, accepted, 2)


RECALL = "WITH l AS (SELECT l_orderkey AS c, l_linenumber AS r, p_size % 2 = 0 AS good FROM lineitem LEFT JOIN part ON p_partkey = l_partkey), g AS (SELECT c, bool_or(r <= 2) AS keyword, bool_or(r BETWEEN 2 AND 3) AS hybrid FROM l WHERE good GROUP BY c) SELECT mode, hits, cases, round(hits / cases, 4) AS recall FROM (SELECT 'keyword' AS mode, count(*) FILTER (WHERE keyword) AS hits, count(*) AS cases FROM g UNION ALL SELECT 'hybrid', count(*) FILTER (WHERE hybrid), count(*) FROM g) x"


def eval_compare(spark, sf):
    """Mean scores by kind of two runs over the cases that both have; a drop of more than five points blocks."""
    d = _t(spark, sf, "documents")
    run = lambda m: d.where(F.col("doc_id") % m != 0).select("doc_id", F.col("lang").alias("kind"), F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise((F.col("doc_id") % (m + 2)) / (m + 1.0)).alias("score"))
    a, b = run(5), run(7).withColumnRenamed("score", "now").drop("kind")
    both = a.join(b, "doc_id").groupBy("kind").agg(F.round(F.avg("score"), 4).alias("before"), F.round(F.avg("now"), 4).alias("after"), F.count("*").alias("cases"))
    return both.withColumn("blocked", F.col("before") - F.col("after") > 0.05)


COMPARE = "WITH d AS (SELECT doc_id, lang AS kind FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0), s AS (SELECT kind, CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 7) / 6.0 END AS a, CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 9) / 8.0 END AS b FROM d), g AS (SELECT kind, round(avg(a), 4) AS before, round(avg(b), 4) AS after, count(*) AS cases FROM s GROUP BY kind) SELECT *, before - after > 0.05 AS blocked FROM g"


def cosine_stats(spark, sf):
    """How near two encodings of the same texts are: here the vectors and their values at one digit."""
    e = _t(spark, sf, "embeddings").select(search.cosine(F.col("embedding"), F.transform("embedding", lambda x: F.round(x.cast("double"), 1))).alias("c"))
    p1 = ranks.interpolated(e, [], "c", {"p1": 0.01}).select(F.round("p1", 6).alias("p1"))
    return e.agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean")).join(p1)  # a row each


COSINE_STATS = "WITH e AS (SELECT list_cosine_similarity(CAST(embedding AS double[]), list_transform(embedding, lambda x: round(CAST(x AS double), 1))) AS c FROM embeddings) SELECT count(*) AS n, round(min(c), 6) AS least, round(quantile_cont(c, 0.01), 6) AS p1, round(avg(c), 6) AS mean FROM e"


def label_counts(spark, sf):
    """Judged answers by outcome, those without a judgement left out of the means."""
    j = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.round(F.avg("quality"), 4).alias("good"), F.round(F.avg("toxic"), 4).alias("toxic"))


def table_blocks(spark, sf):
    """Pages with a table of their own numbers behind their html."""
    cells = F.concat(F.lit("<table border=1><tr><th>id</th><th> size </th></tr>\n<tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td><b>"), F.length("url").cast("string"), F.lit("</b></td></tr></table>"))
    return documents.html_tables(_t(spark, sf, "pages").select("page_id", F.concat("html", cells).alias("html")))


def copy_lookup(spark, sf):
    """A versioned copy is written, found by its pointer, and asked without regard to case."""
    kept = store.Copies(spark, scratch(spark, "copies"))
    kept.write("nations", _t(spark, sf, "nation"), dt.datetime(2000, 6, 30), sort="n_name")
    return kept.lookup("nations", "n_name", "NATION_7").select("n_nationkey", "n_name")


def named_parameters(spark, sf):
    """A statement with bound parameters: values never become text."""
    _t(spark, sf, "orders").createOrReplaceTempView("orders_bound")
    return spark.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_bound WHERE o_orderdate >= :start AND o_orderdate < :end GROUP BY o_orderstatus", args={"start": dt.datetime(1997, 1, 1), "end": dt.datetime(1998, 1, 1)})


def _copy(name: str):
    def run(spark, sf):
        df = copies.SPECS[name][1](CATALOG.load(spark, sf))
        return df.select(*[df[c].cast("string").alias(c) if k == "date" else df[c] for c, k in df.dtypes])

    return run


QUERIES = {f"copy_{n}": (_copy(n), CATALOG.with_views(sql)) for n, sql in copies.SQL.items()} | {
    "bm25_topk": (bm25_topk, _bm25("", 20)),
    "bm25_filtered": (bm25_filtered, _bm25("WHERE lang = 'de'", 10, GERMAN)),
    "cosine_topk": (cosine_topk, COSINE),
    "rrf_merge": (rrf_merge, RRF),
    "hybrid_retrieve": (hybrid_retrieve, None),
    "hash_dedupe": (hash_dedupe, "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "embed_anti_cache": (embed_anti_cache, "SELECT sha256(text) AS hash, CAST(length(min(text)) AS int) AS n_chars FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY 1"),
    "cache_prune": (cache_prune, "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IN (SELECT text FROM documents WHERE lang = 'en')"),
    "change_detection": (change_detection, "SELECT doc_id, CASE WHEN doc_id < 20 THEN 'new' WHEN doc_id % 11 = 0 THEN 'gone' ELSE 'changed' END AS state FROM documents WHERE (doc_id < 20 AND doc_id % 11 <> 0) OR (doc_id >= 20 AND (doc_id % 11 = 0 OR doc_id % 7 = 0))"),
    "chunk_documents": (chunk_documents, None),
    "repeated_lines": (repeated_lines, REPEATED),
    "contents_pages": (contents_pages, CONTENTS),
    "superseded": (superseded, SUPERSEDED),
    "index_consistency": (index_consistency, CONSISTENT),
    "duplicate_names": (duplicate_names, "SELECT name, path, indexed FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY indexed DESC, path) AS rn FROM (SELECT 'file' || (doc_id % 50) || '.pdf' AS name, source || '/' || doc_id AS path, doc_id % 9 = 0 AS indexed FROM documents) f) x WHERE rn = 1"),
    "inherited_attributes": (inherited_attributes, INHERITED),
    "even_sample": (even_sample, "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) x WHERE i IN (SELECT k * n // 10 FROM (SELECT unnest(range(10)) AS k) y)"),
    "value_lookup": (value_lookup, None),
    "answered_questions": (answered_questions, "SELECT u.conv_id, u.turn, CAST(length(u.text) AS int) AS question_chars, CAST(length(a.text) AS int) AS answer_chars FROM conversations u INNER JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"),
    "recent_questions": (recent_questions, r"WITH t AS (SELECT * FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC, text LIMIT 200) SELECT conv_id, turn, CAST(length(text) AS int) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY conv_id DESC, turn DESC, text) AS rn FROM t) x WHERE rn = 1"),
    "upsert_turns": (upsert_turns, "WITH o AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) SELECT CASE WHEN conv_id % 4 = 0 THEN 'edited' ELSE role END AS role, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END AS stamp, count(*) AS n FROM o GROUP BY 1, 2"),
    "purge_old": (purge_old, PURGED),
    "redact_by_request": (redact_by_request, REDACTED),
    "rotated_logs": (rotated_logs, "SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS event_type, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE round(value, 4) END AS value FROM events"),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type"),
    "events_json": (events_json, "SELECT event_type, CAST(sum(k) AS bigint) AS k, count(*) FILTER (WHERE k IS NULL) AS nulls FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events) x GROUP BY event_type"),
    "calls_today": (calls_today, CALLS),
    "windowed_events": (windowed_events, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "usage_counts": (usage_counts, "SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[ঀ-৿]+'))) AS word FROM conversations WHERE role = 'user') x GROUP BY word ORDER BY n DESC, word LIMIT 50"),
    "hit_rate": (hit_rate, "SELECT round(avg(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END), 4) AS rate, count(*) AS cases FROM labels WHERE quality = 1"),
    "registry_stats": (registry_stats, REGISTRY),
    "recall_at_two": (recall_at_two, RECALL),
    "eval_compare": (eval_compare, COMPARE),
    "cosine_stats": (cosine_stats, COSINE_STATS),
    "label_counts": (label_counts, "SELECT lang, count(*) AS n, count(quality) AS judged, round(avg(quality), 4) AS good, round(avg(toxic), 4) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"),
    "table_blocks": (table_blocks, """SELECT page_id, 0 AS "table", 0 AS "row", '| id | size |' AS text FROM pages UNION ALL SELECT page_id, 0, 1, '| ' || page_id || ' | ' || length(url) || ' |' FROM pages"""),
    "copy_lookup": (copy_lookup, "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_7'"),
    "named_parameters": (named_parameters, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_orderstatus"),
}
