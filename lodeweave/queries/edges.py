"""Sources, sinks, external calls, streams and model baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as TX
from lodeweave.operators import external as X
from lodeweave.operators import metrics as M
from lodeweave.operators import models as ML
from lodeweave.queries.retrieval import bank
from lodeweave.queries.sequences import NORMAL_FORM
from lodeweave.session import shared_folder, table
from lodeweave.sources import files as FS
from lodeweave.sources import records as R
from lodeweave.sources import reports as RP
from lodeweave.streaming import events as S


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions written as JSON lines in two steps and read under an explicit schema."""
    m = table(spark, sf_dir, "mentions").select("review_id", "product_id", "attribute_id", "polarity", "explicit_fact_hit")
    path = shared_folder(spark, "records")
    R.write_records(m.filter("explicit_fact_hit"), path)
    R.write_records(m.filter("not explicit_fact_hit"), path, append=True)
    return R.read_records(spark, path, m.schema).groupBy("polarity", "explicit_fact_hit").agg(F.count("*").alias("n"), F.count("attribute_id").alias("with_attribute"))


def partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips in one folder per category, read as their union with pruned partitions."""
    path = shared_folder(spark, "clips")
    R.write_by(table(spark, sf_dir, "clips"), path, "category")
    return spark.read.parquet(path).filter("category in ('食品', '美妆')").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"))


def incremental_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output that gets only the keys it lacks."""
    path = shared_folder(spark, "products")
    p = table(spark, sf_dir, "products").select("product_id", "title")
    R.append_missing(p.filter(F.pmod(F.crc32("product_id"), F.lit(2)) == 0), path, "product_id")
    R.append_missing(p, path, "product_id")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"))


def client_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD10: whether the clients of models can be reached from the executors; the judge gets no JSON and says so."""
    ok = X.reachable(spark, X.stub_classifier).select(F.lit("classifier").alias("client"), "ok")
    return ok.unionByName(X.reachable(spark, X.stub_judge).select(F.lit("judge").alias("client"), "ok"))


def resumed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, ST2: products that a job log with bad lines does not have yet."""
    path = shared_folder(spark, "log")
    p = table(spark, sf_dir, "products").select("product_id").distinct()
    done = p.filter(F.length("product_id") + F.col("product_id").cast("decimal(20,0)") % 3 >= 20)
    done.select(F.to_json(F.struct("product_id")).alias("value")).unionByName(done.select(F.concat(F.lit("{bad "), "product_id").alias("value"))).write.text(path)
    left = p.join(R.done_keys(spark, path, "product_id"), "product_id", "left_anti")
    return left.agg(F.count("*").alias("n_left"), F.min("product_id").alias("first"), F.max("product_id").alias("last"))


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document over several lines put in place at once and read back; a missing one is an empty table."""
    path = shared_folder(spark, "summary") + ".json"
    counts = table(spark, sf_dir, "category_schema").groupBy("category").agg(F.count("*").alias("n")).collect()  # a fixed table
    RP.write_document(spark, path, {"old": True})
    RP.write_document(spark, path, {"categories": [{"category": r[0], "n": r[1]} for r in sorted(counts)]})
    schema = "categories array<struct<category: string, n: bigint>>"
    both = R.read_document(spark, path, schema).unionByName(R.read_document(spark, path + ".none", schema))
    return both.select(F.explode("categories").alias("c")).select("c.*")


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of a glob with the key that their name holds."""
    path = shared_folder(spark, "results")
    s = table(spark, sf_dir, "samples").select("sample_id", "y", "c")
    for seed in (0, 1, 2):
        s.filter(F.col("sample_id") % 3 == seed).write.parquet(f"{path}/xdom_seed{seed}.parquet")
    rows = R.read_results(spark, f"{path}/xdom_seed*.parquet", r"xdom_seed(\d+)\.parquet")
    return rows.groupBy("file_key").agg(F.count("*").alias("n"), F.count("y").alias("labelled"))


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as Markdown and read as its lines."""
    path = shared_folder(spark, "report") + ".md"
    t = table(spark, sf_dir, "samples").groupBy("confidence").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
    RP.write_text(spark, path, RP.markdown(t, ["confidence"]))
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("line"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the lines of a job's output that begin with a mark."""
    path = shared_folder(spark, "stdout")
    s = table(spark, sf_dir, "samples").filter("y is not null")
    line = F.concat(F.lit("RESULT "), F.to_json(F.struct("sample_id", "y")))
    s.select(F.explode(F.array(F.lit("epoch 1"), line, F.concat(F.lit(" "), line))).alias("value")).write.text(path)
    return R.read_marked(spark, path, "sample_id long, y int").groupBy("y").agg(F.count("*").alias("n"), F.sum("sample_id").alias("id_sum"))


def review_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews exported as HTML tables and read back: trimmed, empty ones dropped, polarity of the sentiment."""
    path = shared_folder(spark, "sheets")
    m = table(spark, sf_dir, "mentions").select("review_id", "review_text", "review_time", "review_polarity", "product_id").distinct()
    mood = F.when(F.col("review_polarity") == "pos", "好评").when(F.col("review_polarity") == "neg", " 差评 ").otherwise("无")
    FS.write_review_sheets(m.select(F.concat(F.lit(" "), F.coalesce("review_text", F.lit(""))).alias("text"), F.col("review_time").alias("time"), mood.alias("sentiment"), F.col("product_id").alias("shop")), path)
    rows = FS.read_review_sheets(spark, f"{path}/part-*")
    return rows.groupBy("shop", "polarity").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count(F.nullif("time", F.lit(""))).alias("timed"))


def slim_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slimmed copy of the samples with the bytes before and after."""
    path = shared_folder(spark, "slim")
    sizes = RP.slimmed(spark, f"{sf_dir}/samples.parquet", path, ["sample_id", "pair_id", "y", "c"])
    rows = spark.read.parquet(path)
    return rows.agg(F.count("*").alias("n"), F.count("y").alias("labelled")).withColumn("n_columns", F.lit(len(rows.columns))).withColumn("smaller", F.lit(sizes["after"] < sizes["before"]))


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data URLs of image files; what is no image is passed on with the type of its name."""
    path = shared_folder(spark, "images")
    for name in ("a.png", "b.webp", "c.jpg"):
        RP.write_bytes(spark, f"{path}/{name}", f"no image {name}".encode())
    return RP.data_urls(spark.read.format("binaryFile").load(path).select("path", "content")).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "url")


def risk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD9, M18: risk scores of the passages by an injected model; missing scores are 0.5, missing decisions 0."""
    s = table(spark, sf_dir, "samples").select(F.col("sample_id").cast("string").alias("key"), F.coalesce("claim.passage", F.lit("")).alias("request"))
    return X.risk_scores(s, X.stub_risk).select(F.col("key").cast("long").alias("sample_id"), "score", "decision")


def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD1 to UD4, S23: review texts classified by an injected client through the cache."""
    texts = table(spark, sf_dir, "mentions").select(F.col("review_text").alias("request")).filter("request is not null").distinct()
    asked = texts.withColumn("key", X.content_key("request"))
    return X.cached_calls(asked, X.stub_classifier, shared_folder(spark, "responses")).groupBy("response").agg(F.count("*").alias("n"))


def aspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD5: aspects of review texts by a table function."""
    spark.udtf.register("aspects", X.Aspects)
    texts = table(spark, sf_dir, "mentions").select("review_id", "review_text").distinct()
    return spark.sql("select review_id, aspect, position from {t}, lateral aspects(review_text)", t=texts)


def alignment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD8, X38: alignment of each review of a sample with its passage, decoded to 0 and 1."""
    s = table(spark, sf_dir, "samples").filter("claim.passage <> '' and size(reviews) > 0").select("sample_id", F.col("claim.passage").alias("claim"), F.transform("reviews", lambda r: F.coalesce(r["text"], F.lit(""))).alias("comments"))
    asked = s.withColumn("request", F.to_json(F.struct("claim", "comments"))).withColumn("key", F.col("sample_id").cast("string"))
    said = X.call_many(asked, X.stub_judge).select(F.col("key").cast("long").alias("sample_id"), "response")
    rows = s.join(said, "sample_id").select("sample_id", F.posexplode(X.decoded_alignment(F.col("response"), F.size("comments"))).alias("i", "aligned"))
    return rows.groupBy("sample_id").agg(F.sum("aligned").alias("n_aligned"), F.count("*").alias("n"))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 (extension): events per type and window of three days from a stream."""
    return S.drained(S.bursts(S.read_events(spark, f"{sf_dir}/events.parquet"))).select(F.col("start").cast("string").alias("start"), "event_type", "n", "total")


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 (extension): a stream joined with a static table."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = S.enriched(S.read_events(spark, f"{sf_dir}/events.parquet"), users).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return S.drained(rows)


def linear_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of three linear models on the claims' texts."""
    s = table(spark, sf_dir, "samples").filter("y is not null and split is not null").select("sample_id", "split", F.col("y").cast("double").alias("label"), "y", F.greatest("c", F.lit(0.05)).alias("w"), F.concat_ws(" ", "attribute_name", "claim.passage", F.array_join("evidence_ocr.raw_text", " ")).alias("text"))
    rows = ML.features(s, "text")
    out = None
    for name in ML.MODELS:
        one = M.ranking_metrics(ML.scored(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), name).select("p", "y")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def evidence_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of one linear model on the claim, on the evidence and on both."""
    s = table(spark, sf_dir, "samples").filter("y is not null and split is not null")
    texts = {"claim": F.col("claim.passage"), "evidence": F.array_join(F.concat("evidence_params.raw_text", "evidence_ocr.raw_text"), " ")}
    texts["both"] = F.concat_ws(" ", *texts.values())
    out = None
    for name, text in texts.items():
        rows = ML.features(s.select("split", F.col("y").cast("double").alias("label"), "y", F.greatest("c", F.lit(0.05)).alias("w"), text.alias("text")), "text")
        one = M.ranking_metrics(ML.scored(rows.filter("split = 'train'"), rows.filter("split <> 'train'")).select("p", "y")).withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def frozen_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of three models on the fixed vectors."""
    b = bank(spark, sf_dir).withColumns({"label": F.col("y").cast("double"), "w": F.greatest("c", F.lit(0.05))})
    out = None
    for name in ("logistic", "svm", "perceptron"):
        one = M.ranking_metrics(ML.frozen(b.filter("id % 50 <> 0"), b.filter("id % 50 = 0"), "embedding", 64, name).select("p", "y")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def vector_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as packed floats and read back."""
    path = shared_folder(spark, "vectors")
    R.write_vectors(table(spark, sf_dir, "embeddings"), path, "embedding")
    rows = R.read_vectors(spark, path, "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", "label", F.size("embedding").alias("width"), F.round(total, 5).alias("total"))


def embedded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema names embedded by an injected client, of unit length, in long form."""
    names = table(spark, sf_dir, "category_schema").select("attribute_id", F.col("canonical_name").alias("text"))
    return X.embedded(names, X.stub_embedder).select("attribute_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD7, X39: for each product and attribute of its category the values of the parameters that match the attribute's
    names, and the pages whose text has one of them."""
    category = table(spark, sf_dir, "clips").filter("trim(category) <> ''").groupBy("product_id").agg(F.min("category").alias("category"))
    schema = table(spark, sf_dir, "category_schema").select("category", "attribute_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array())))).alias("name")).filter("name <> ''")
    p = table(spark, sf_dir, "products").filter("raw_params is not null").select("product_id", F.explode("raw_params").alias("k", "v")).distinct().join(category, "product_id")
    params = p.join(schema, "category").filter(TX.normalized(F.col("k")) == TX.normalized(F.col("name"))).select("product_id", "attribute_id", F.lit("params").alias("kind"), F.concat_ws(":", "k", "v").alias("item"))
    d = table(spark, sf_dir, "documents").filter("doc_kind in ('ocr_page', 'detail_page') and product_id is not null").select("product_id", "doc_id", "text").join(category, "product_id")
    pages = d.join(schema, "category").filter(F.contains("text", F.col("name"))).select("product_id", "attribute_id", F.lit("page").alias("kind"), F.col("doc_id").cast("string").alias("item"))
    found = params.unionByName(pages).distinct()
    return found.groupBy("product_id", "attribute_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("items"))


def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores with the pairs of a product in one fold."""
    s = table(spark, sf_dir, "samples").filter("y is not null").select("sample_id", F.split_part("pair_id", F.lit("__"), F.lit(1)).alias("product"), F.col("y").cast("double").alias("label"), "y", F.greatest("c", F.lit(0.05)).alias("w"), F.col("claim.passage").alias("text"))
    return ML.out_of_fold(ML.features(s, "text"), "product").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


QUERIES = {f.__name__: f for f in (json_lines, partitioned_output, incremental_output, client_ping, resumed_jobs, json_document, result_files, markdown_report, marked_lines, review_sheets, slim_copy, image_urls, risk_answers, external_calls, aspect_rows, alignment_vectors, stream_bursts, stream_enriched, linear_baselines, evidence_views, frozen_vectors, vector_bundle, embedded_names, evidence_lists, out_of_fold_scores)}
_WORDS = "case when regexp_matches(review_text, '偏大|偏小|尺码') then 'size' when regexp_matches(review_text, '客服|物流|快递') then 'service' when regexp_matches(review_text, '起球|开了口|坏了') then 'quality' else 'other' end"
_POS = lambda ws: "coalesce(" + ", ".join(f"nullif(instr(review_text, '{w}'), 0)" for w in ws) + ") - 1"
_ASPECTS = [("size", ("偏大", "偏小", "尺码")), ("service", ("客服", "物流")), ("smell", ("味道", "异味")), ("price", ("块", "性价比"))]
SQL = {
    "json_lines": "select polarity, explicit_fact_hit, count(*) n, count(attribute_id) with_attribute from mentions group by 1, 2",
    "partitioned_output": "select category, count(*) n, count(distinct product_id) products from clips where category in ('食品', '美妆') group by 1",
    "incremental_output": "select count(distinct product_id) n, count(distinct product_id) products from products",
    "client_ping": "select * from (values ('classifier', true), ('judge', false)) t(client, ok)",
    "resumed_jobs": "select count(*) n_left, min(product_id) first, max(product_id) last from (select distinct product_id from products where length(product_id) + product_id::hugeint % 3 < 20)".replace(" first", ' "first"').replace(" last ", ' "last" '),
    "json_document": "select category, count(*) n from category_schema group by 1",
    "result_files": "select (sample_id % 3)::varchar file_key, count(*) n, count(y) labelled from samples group by 1",
    "markdown_report": "select '| confidence | n | positive |' line union all select '|---|---|---|' union all select '| ' || confidence || ' | ' || count(*) || ' | ' || sum(y) || ' |' from samples group by confidence",
    "marked_lines": "select y, count(*) n, sum(sample_id)::bigint id_sum from samples where y is not null group by 1",
    "review_sheets": "with m as (select distinct review_id, review_text, review_time, review_polarity, product_id from mentions), t as (select *, trim(replace(review_text, chr(10), ' '), ' ') t from m) select product_id shop, case review_polarity when 'pos' then 'pos' when 'neg' then 'neg' else 'neu' end polarity, count(*) n, sum(length(t))::bigint chars, count(nullif(trim(review_time, ' '), '')) timed from t where t <> '' group by 1, 2",
    "slim_copy": "select count(*) n, count(y) labelled, 4 n_columns, true smaller from samples",
    "image_urls": "select name, 'data:' || kind || ';base64,' || to_base64(('no image ' || name)::blob) url from (values ('a.png', 'image/png'), ('b.webp', 'image/webp'), ('c.jpg', 'image/jpeg')) t(name, kind)",
    "risk_answers": "with r as (select sample_id, length(coalesce(claim.passage, '')) n from samples) select sample_id, case when n % 7 = 0 or n % 5 = 0 then 0.5 else least(1.0, n / 100) end::double score, case when n % 7 = 0 then 0 else n % 2 end::int decision from r",
    "vector_bundle": "select vec_id, label, len(embedding)::int width, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) total from embeddings",
    "embedded_names": "with c as (select attribute_id, unnest(string_split(canonical_name, '')) ch from category_schema), k as (select attribute_id, instr('0123456789abcdef', substr(md5(ch), 1, 1)) - 1 p, count(*) n from c where ch <> '' group by 1, 2), z as (select attribute_id, sqrt(sum(n * n)) z from k group by 1) select z.attribute_id, g.p::int pos, round(coalesce(n, 0) / z, 6) x from z cross join (select unnest(range(0, 16)) p) g left join k on k.attribute_id = z.attribute_id and k.p = g.p",
    "evidence_lists": f"""with cat as (select product_id, min(category) category from clips where trim(category) <> '' group by 1), sc as (select distinct category, attribute_id, unnest(list_concat([canonical_name], coalesce(aliases, []))) name from category_schema), pr as (select distinct product_id, unnest(map_entries(raw_params)) e from products where raw_params is not null),
 f as (select pr.product_id, attribute_id, 'params' kind, e.key || ':' || e.value item from pr join cat using (product_id) join sc using (category) where {NORMAL_FORM.format('e.key')} = {NORMAL_FORM.format('name')} union select d.product_id, attribute_id, 'page', doc_id::varchar from documents d join cat on cat.product_id = d.product_id join sc on sc.category = cat.category where doc_kind in ('ocr_page', 'detail_page') and contains(d.text, name) and name <> '')
 select product_id, attribute_id, kind, string_agg(item, '|' order by item) items from f group by 1, 2, 3""",
    "external_calls": f"select {_WORDS} response, count(*) n from (select distinct review_text from mentions where review_text is not null) group by 1",
    "aspect_rows": "with t as (select distinct review_id, review_text from mentions) " + " union all ".join(f"select review_id, '{a}' aspect, ({_POS(ws)})::int as position from t where {_POS(ws)} is not null".replace("as position", 'as "position"') for a, ws in _ASPECTS),
    "alignment_vectors": "with s as (select sample_id, claim.passage p, unnest(reviews) r from samples where claim.passage <> '' and len(reviews) > 0) select sample_id, sum((len(list_intersect(list_distinct(string_split(p, '')), list_distinct(string_split(coalesce(r.text, ''), '')))) >= 3)::int)::bigint n_aligned, count(*) n from s group by 1",
    "stream_bursts": "select strftime(time_bucket(interval 3 days, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2".replace("as start", 'as "start"'),
    "stream_enriched": "select c_mktsegment, count(*) n from events e left join customer c on e.user_id = c.c_custkey group by 1",
}
