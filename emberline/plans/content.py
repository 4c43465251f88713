"""Queries over texts, vectors, boxes and training records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import datasets as DS
from emberline.operators import detection as D
from emberline.operators import retrieval as V
from emberline.sources import adapters as A

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_PAIRS = "FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id < 10"


@query("knn_cosine", f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score {_PAIRS}) SELECT query_id, vec_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8")
def knn_cosine(spark, d):
    e = A.table(spark, d, "embeddings")
    return V.nearest(e, e.where("vec_id < 10"), 8).withColumn("score", F.round("score", 5))


@query("knn_l2", f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, 1 / (1 + list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS score {_PAIRS}) SELECT query_id, vec_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def knn_l2(spark, d):
    e = A.table(spark, d, "embeddings")
    return V.nearest(e, e.where("vec_id < 10"), 5, "l2").withColumn("score", F.round("score", 5))


@query("knn_cosine_hundredths")
def knn_cosine_hundredths(spark, d):
    """The job's query set: every id divisible by 100."""
    e = A.table(spark, d, "embeddings")
    return V.nearest(e, e.where("vec_id % 100 = 0"), 8).withColumn("score", F.round("score", 5))


@query("knn_l2_hundredths")
def knn_l2_hundredths(spark, d):
    e = A.table(spark, d, "embeddings")
    return V.nearest(e, e.where("vec_id % 100 = 0"), 5, "l2").withColumn("score", F.round("score", 5))


@query("knn_filtered", "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id < 10 AND c.label = 3) SELECT query_id, vec_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def knn_filtered(spark, d):
    e = A.table(spark, d, "embeddings")
    return V.nearest(e.where("label = 3"), e.where("vec_id < 10"), 3).withColumn("score", F.round("score", 5))


@query("chunk_documents", "WITH c AS (SELECT doc_id, text, unnest(list_filter(range(0, greatest(length(text), 1), 1050), lambda x: x = 0 OR x + 150 < length(text))) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(start // 1050 AS INTEGER) AS chunk, CAST(length(substr(text, start + 1, 1200)) AS INTEGER) AS n, md5(substr(text, start + 1, 1200)) AS digest FROM c")
def chunk_documents(spark, d):
    c = V.chunk(A.table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("section_split", r"""WITH p AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY ALL), s AS (SELECT conv_id, unnest(string_split_regex(body, '(?m)^##\s+')) AS part, generate_subscripts(string_split_regex(body, '(?m)^##\s+'), 1) AS i FROM p) SELECT conv_id, CAST(i - 1 AS INTEGER) AS section, split_part(part, chr(10), 1) AS heading FROM s WHERE i > 1""")
def section_split(spark, d):
    t = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("x")))).alias("x"))
    body = F.array_join(F.transform("x", lambda v: v["x"]), "\n")
    return t.select("conv_id", F.posexplode(S.sections(body)).alias("section", "part")).where("section > 0").select("conv_id", "section", F.split_part("part", F.lit("\n"), F.lit(1)).alias("heading"))


@query("infer_domain", "SELECT p_partkey, CASE WHEN regexp_matches(lower(k), 'dc-fw|fw-|-fw|firewall|packet_drop|packet drop|acl') THEN 'firewall' WHEN regexp_matches(lower(k), '-lb|lb-|load_balancer|load balancer|backend_pool|backend pool|unhealthy|health_probe|health probe') THEN 'load_balancer' WHEN regexp_matches(lower(k), 'db_master|db-|-db|database|connection_pool|connection pool|replica') THEN 'database' WHEN regexp_matches(lower(k), 'wan_pe|pe-|-pe|wan|bgp|ospf|mpls|circuit|link_down|link down|sfp|carrier') THEN 'wan' ELSE '' END AS domain FROM (SELECT p_partkey, ['DC-FW-01', 'app-LB-2', 'DB-master', 'WAN-PE-1', 'oracle', p_name][p_partkey % 6 + 1] AS k FROM part)")
def infer_domain(spark, d):
    k = F.element_at(F.array(*[F.lit(x) for x in ("DC-FW-01", "app-LB-2", "DB-master", "WAN-PE-1", "oracle")], F.col("p_name")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", V.domain(k).alias("domain"))


@query("domain_first_order", "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, doc_id) AS INTEGER) AS place FROM documents")
def domain_first_order(spark, d):
    return V.domain_first(A.table(spark, d, "documents").select("doc_id", "source", "lang"), "source", F.col("lang") == "de", "doc_id").drop("lang")


@query("vector_upsert", "WITH u AS (SELECT 'k' || user_id AS id, event_id AS version, event_type AS payload FROM events) SELECT id, version, payload FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def vector_upsert(spark, d):
    u = A.table(spark, d, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("payload"))
    return V.upsert(u.where("version % 2 = 0"), u.where("version % 2 = 1"), "id", "version")


@query("doc_hash_ids", "SELECT doc_id, sha1(source || '|' || lang || '|' || text) AS id FROM documents")
def doc_hash_ids(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha1(F.concat_ws("|", "source", "lang", "text").cast("binary")).alias("id"))


_BOX = "SELECT p_partkey AS id, p_partkey % 40 AS image, CAST(p_size % 4 AS INTEGER) AS class_id, (p_partkey * 37 % 400)::DOUBLE + {0} AS x1, (p_partkey * 53 % 300)::DOUBLE + {0} AS y1, (p_partkey * 37 % 400)::DOUBLE + {0} + 20 + p_size AS x2, (p_partkey * 53 % 300)::DOUBLE + {0} + 30 + p_size AS y2, p_retailprice / 3000 AS confidence FROM part"
_BOXES = f"WITH t AS ({_BOX.format('0')}), d AS ({_BOX.format('(p_partkey % 13)')})"
_AREA = "((d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {i})"
_INTER = "(greatest(0.0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0.0, least(d.y2, t.y2) - greatest(d.y1, t.y1)))"
_IOU = f"({_INTER} / {_AREA.format(i=_INTER)})"


def _boxes(spark, d, shift):
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 400).cast("double") + shift, (k * 53 % 300).cast("double") + shift
    return A.table(spark, d, "part").select(k.alias("id"), (k % 40).alias("image"), (size % 4).cast("int").alias("class_id"), x.alias("x1"), y.alias("y1"), (x + 20 + size).alias("x2"), (y + 30 + size).alias("y2"), (F.col("p_retailprice") / 3000).alias("confidence"))


@query("iou_join", _BOXES + f", p AS (SELECT d.image, d.class_id, d.id AS d_id, t.id AS t_id, {_IOU} AS iou FROM d JOIN t ON d.image = t.image AND d.class_id = t.class_id) SELECT image, class_id, d_id, t_id, round(iou, 6) AS iou FROM p WHERE iou >= 0.1")
def iou_join(spark, d):
    p = D.overlaps(_boxes(spark, d, F.col("p_partkey") % 13), _boxes(spark, d, 0), ["image", "class_id"], 0.1, 6)
    return p.drop("confidence")


_AP = _BOXES + ", s AS (SELECT class_id, id, confidence, id % 3 <> 0 AS hit FROM d), n AS (SELECT class_id, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT s.class_id, s.id, confidence, sum(hit::INTEGER) OVER w / row_number() OVER w AS p, sum(hit::INTEGER) OVER w / n AS r FROM s JOIN n USING (class_id) WINDOW w AS (PARTITION BY s.class_id ORDER BY confidence DESC, s.id ROWS UNBOUNDED PRECEDING)), g AS (SELECT *, lag(p, 1, 1.0) OVER v AS p0, lag(r, 1, 0.0) OVER v AS r0 FROM c WINDOW v AS (PARTITION BY class_id ORDER BY confidence DESC, id)) SELECT class_id, round(sum((r - r0) * (p + p0) / 2), 6) AS ap FROM g GROUP BY ALL"


@query("average_precision", _AP)
def average_precision(spark, d):
    b = _boxes(spark, d, F.col("p_partkey") % 13)
    n = _boxes(spark, d, 0).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    s = b.select("class_id", "id", "confidence", (F.col("id") % 3 != 0).alias("hit")).join(n, "class_id")
    return D.average_precision(s, "class_id", [F.desc("confidence"), "id"], "hit", "n").withColumn("ap", F.round("ap", 6))


@query("confusion_matrix", "SELECT o_orderstatus AS predicted, l_linestatus AS truth, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def confusion_matrix(spark, d):
    j = A.table(spark, d, "orders").join(A.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_orderstatus").alias("predicted"), F.col("l_linestatus").alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query("detection_metrics", _BOXES + ", s AS (SELECT d.class_id, d.id % 3 <> 0 AS hit FROM d) SELECT class_id, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp, round(count(*) FILTER (WHERE hit) / count(*), 6) AS prec FROM s GROUP BY ROLLUP (class_id)")
def detection_metrics(spark, d):
    s = _boxes(spark, d, F.col("p_partkey") % 13).select("class_id", (F.col("id") % 3 != 0).alias("hit"))
    return s.rollup("class_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("prec"))


@query("class_shift_best", "WITH t AS (SELECT p_partkey AS id, p_size % 5 AS truth, (p_size + 1) % 5 AS pred FROM part), e AS (SELECT s AS shift, avg(CAST((pred + s + 5) % 5 = truth AS INTEGER)) AS f1 FROM t, (VALUES (0), (1), (-1)) AS v(s) GROUP BY ALL) SELECT shift, round(f1, 6) AS f1 FROM e ORDER BY f1 DESC, shift LIMIT 1")
def class_shift_best(spark, d):
    t = A.table(spark, d, "part").select((F.col("p_size") % 5).alias("truth"), ((F.col("p_size") + 1) % 5).alias("pred"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("shift"))
    e = t.groupBy("shift").agg(F.round(F.avg(((F.col("pred") + F.col("shift") + 5) % 5 == F.col("truth")).cast("double")), 6).alias("f1"))
    return e.orderBy(F.desc("f1"), "shift").limit(1)


@query("greedy_match")
def greedy_match(spark, d):
    m = D.match(_boxes(spark, d, F.col("p_partkey") % 13), _boxes(spark, d, 0), ["image", "class_id"], 0.1)
    return m.select("image", "class_id", "id", "t_id", F.round("iou", 6).alias("iou"))


@query("non_max_suppression")
def non_max_suppression(spark, d):
    return D.suppress(_boxes(spark, d, F.col("p_partkey") % 13), "image", 0.3).select("image", "id")


@query("nearest_box", f"WITH t AS ({_BOX.format('0')}), p AS (SELECT s_suppkey AS point_id, s_suppkey % 40 AS image, (s_suppkey * 41 % 420)::DOUBLE AS x, (s_suppkey * 29 % 320)::DOUBLE AS y FROM supplier), j AS (SELECT p.image, point_id, id, sqrt(power(greatest(x1 - x, 0, x - x2), 2) + power(greatest(y1 - y, 0, y - y2), 2)) AS dist FROM p JOIN t ON p.image = t.image) SELECT image, point_id, id AS box_id, round(dist, 6) AS distance FROM j WHERE dist <= 80 QUALIFY row_number() OVER (PARTITION BY image, point_id ORDER BY dist, id) = 1")
def nearest_box(spark, d):
    k = F.col("s_suppkey")
    p = A.table(spark, d, "supplier").select(k.alias("point_id"), (k % 40).alias("image"), (k * 41 % 420).cast("double").alias("x"), (k * 29 % 320).cast("double").alias("y"))
    return D.nearest_box(p, _boxes(spark, d, 0), "image").withColumn("distance", F.round("distance", 6))


@query("yolo_export", f"WITH t AS ({_BOX.format('0')}) SELECT id, printf('%d %.6f %.6f %.6f %.6f', class_id, least(1.0, (x1 + x2) / 2 / 500), least(1.0, (y1 + y2) / 2 / 400), (x2 - x1) / 500, (y2 - y1) / 400) AS line FROM t")
def yolo_export(spark, d):
    return DS.yolo_lines(_boxes(spark, d, 0), F.lit(500), F.lit(400)).select("id", "line")


@query("coco_export", f"WITH t AS ({_BOX.format('0')}), i AS (SELECT DISTINCT image, printf('img%03d', image) AS file_name FROM t), k AS (SELECT image, dense_rank() OVER (ORDER BY file_name) AS image_id FROM i), b AS (SELECT image_id, class_id, x1, y1, least(x2, 400.0) AS x2, least(y2, 300.0) AS y2 FROM t JOIN k USING (image)) SELECT CAST(image_id AS INTEGER) AS image_id, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 3) AS area FROM b WHERE x2 > x1 AND y2 > y1 GROUP BY ALL")
def coco_export(spark, d):
    b = _boxes(spark, d, 0).withColumn("file_name", F.format_string("img%03d", "image"))
    images = b.select("file_name").distinct().select("file_name", F.lit(400.0).alias("width"), F.lit(300.0).alias("height"))
    _, ann = DS.coco(images, b.select("file_name", "class_id", "x1", "y1", "x2", "y2"))
    return ann.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query("sft_record_violations", "WITH r AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, bool_or(role = 'assistant') AS assistant, bool_or(trim(coalesce(text, '')) = '') AS blank FROM conversations GROUP BY ALL) SELECT conv_id, array_to_string(list_filter([CASE WHEN n <> 3 THEN 'not three messages' END, CASE WHEN first_role <> 'system' THEN 'first is not system' END, CASE WHEN NOT assistant THEN 'no assistant' END, CASE WHEN blank THEN 'empty content' END], lambda x: x IS NOT NULL), '; ') AS violations FROM r")
def sft_record_violations(spark, d):
    v = DS.record_violations(DS.records(A.table(spark, d, "conversations")))
    return v.select("conv_id", F.array_join("violations", "; ").alias("violations"))


@query("hash_split", "SELECT conv_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT conv_id, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS h FROM conversations)")
def hash_split(spark, d):
    return DS.split_by_hash(A.table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("ordered_split", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r, count(*) OVER () AS n FROM c) SELECT conv_id, CASE WHEN r <= least(greatest(1, round(n * 0.9)), greatest(1, n - 1)) THEN 'train' ELSE 'val' END AS split FROM n")
def ordered_split(spark, d):
    return DS.ordered_split(A.table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", 0.9)


@query("chat_format", "SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY ALL")
def chat_format(spark, d):
    r = DS.records(A.table(spark, d, "conversations"))
    return r.select("conv_id", F.md5(DS.chat_text(F.col("messages")).cast("binary")).alias("digest"))


@query("trainer_rows", "SELECT conv_id, CAST(count(*) - 1 AS INTEGER) AS n_prompt, arg_max(text, turn) AS answer FROM conversations GROUP BY ALL")
def trainer_rows(spark, d):
    t = DS.trainer_rows(DS.records(A.table(spark, d, "conversations")))
    return t.select(F.col("extra_info.index").alias("conv_id"), F.size("prompt").alias("n_prompt"), F.col("reward_model.ground_truth.answer").alias("answer"))


@query("device_tokens", r"SELECT s_suppkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b[A-Z]{2,}(?:-[A-Z0-9]+){1,4}\b'))), ',') AS devices, len(regexp_extract_all(t, '\b\d{1,3}(?:\.\d{1,3}){3}\b')) AS n_ips FROM (SELECT s_suppkey, 'DC-FW-' || s_suppkey || ' lost APP-LB-2 at 10.0.' || s_suppkey % 256 || '.7; x-Y, QA' AS t FROM supplier)")
def device_tokens(spark, d):
    k = F.col("s_suppkey")
    t = F.concat(F.lit("DC-FW-"), k.cast("string"), F.lit(" lost APP-LB-2 at 10.0."), (k % 256).cast("string"), F.lit(".7; x-Y, QA"))
    return A.table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(F.array_distinct(S.devices(t))), ",").alias("devices"), F.size(S.addresses(t)).cast("long").alias("n_ips"))


@query("clean_labels", r"SELECT p_partkey, substr(regexp_replace(upper(trim(p_name)), '[^A-Z0-9\-_/.]', '', 'g'), 1, 32) AS label FROM part")
def clean_labels(spark, d):
    return A.table(spark, d, "part").select("p_partkey", S.clean_label(F.col("p_name")).alias("label"))


@query("type_scoped_names", "SELECT p_partkey, p_brand || '-' || printf('%03d', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS name FROM part")
def type_scoped_names(spark, d):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return A.table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), F.format_string("%03d", n)).alias("name"))


_LINKS = [(0, 1), (1, 2), (2, 3)]


@query("typed_neighbours", f"WITH t AS ({_BOX.format('0')}), c AS (SELECT image, id, class_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM t), n AS (SELECT a.image, a.id AS source_id, b.id AS target_id, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS dist FROM c a JOIN c b ON a.image = b.image AND b.class_id = a.class_id + 1) SELECT image, source_id, target_id, round(dist, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY image, source_id ORDER BY dist, target_id) <= 2")
def typed_neighbours(spark, d):
    b = _boxes(spark, d, 0).withColumnRenamed("class_id", "kind")
    return D.typed_neighbours(b, "image", spark.createDataFrame(_LINKS, "kind int, to int")).withColumn("distance", F.round("distance", 6))


@query("degree_capped_links")
def degree_capped_links(spark, d):
    return D.nearest_links(_boxes(spark, d, 0), "image", 120.0)


@query("case_library", "WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'D' || (user_id % 5) AS diagram, count(*) AS n FROM events GROUP BY ALL) SELECT 'ent_' || day AS case_id, 'enterprise' AS mode, CAST(sum(n) AS BIGINT) AS event_count FROM c GROUP BY day UNION ALL SELECT 'topo_' || day || '_' || diagram, 'topology', n FROM c")
def case_library(spark, d):
    e = A.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("D"), (F.col("user_id") % 5).cast("string")).alias("diagram"))
    n = e.rollup("day", "diagram").agg(F.count(F.lit(1)).alias("event_count")).where("day is not null")
    whole = F.col("diagram").isNull()
    return n.select(F.when(whole, F.concat(F.lit("ent_"), "day")).otherwise(F.concat(F.lit("topo_"), "day", F.lit("_"), "diagram")).alias("case_id"), F.when(whole, "enterprise").otherwise("topology").alias("mode"), "event_count")


@query("preference_pairs", "WITH r AS (SELECT conv_id, arg_max(text, turn) AS chosen, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY ALL), u AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY ALL) SELECT conv_id, md5(prompt) AS prompt, md5(chosen) AS chosen, CASE WHEN conv_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM r JOIN u USING (conv_id)")
def preference_pairs(spark, d):
    c = A.table(spark, d, "conversations")
    r = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("chosen"))
    u = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    md5 = lambda n: F.md5(F.col(n).cast("binary")).alias(n)
    return r.join(u, "conv_id").select("conv_id", md5("prompt"), md5("chosen"), F.when(F.col("conv_id") % 5 == 0, "val").otherwise("train").alias("split"))
