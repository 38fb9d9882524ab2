"""Order-sensitive operators, interval joins, families and greedy splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as X
from lodeweave.operators import families as FA
from lodeweave.operators import ordered as O
from lodeweave.operators import ranges as RG
from lodeweave.session import table


def _mentions(spark, sf_dir) -> DataFrame:
    """Distinct mentions with their place in a total order."""
    cols = ["ingested_ts", "review_id", "attribute_id", "polarity", "mention_strength", "explicit_fact_hit", "evidence_span", "mention_type"]
    m = table(spark, sf_dir, "mentions").filter("attribute_id is not null").select("product_id", *cols).distinct()
    return m.withColumn("pos", F.struct(*[F.col(c) if c == "ingested_ts" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def passage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a product and attribute from its spans in order."""
    m = _mentions(spark, sf_dir).filter("evidence_span is not null").withColumn("text", F.col("evidence_span"))
    return O.passages(m, "product_id", "attribute_id")


def fold_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest mention by the fold, per product and attribute, composed by hours."""
    return O.strongest_mention(_mentions(spark, sf_dir), "product_id", "attribute_id", chunk=F.date_trunc("hour", "ingested_ts"))


def cue_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of the transcripts with seconds and character offsets."""
    return O.cues(table(spark, sf_dir, "documents")).select("doc_id", "idx", "start_s", "end_s", "char_start", "char_end", "text")


def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole cues of at most 400 characters."""
    spans = O.cues(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("s"))
    return spans.select("doc_id", F.posexplode(O.chunk_ranges(F.col("s"), 400)).alias("chunk", "r")).select("doc_id", "chunk", F.col("r.a").alias("first"), F.col("r.z").alias("last"))


def _intervals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cues = O.cues(table(spark, sf_dir, "documents")).select("doc_id", "idx", F.col("char_start").alias("r_start"), F.col("char_end").alias("r_end"))
    total = cues.groupBy("doc_id").agg(F.max("r_end").alias("n")).filter("n > 0")
    claims = total.select("doc_id", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / 90).cast("int"))).alias("k")).select("doc_id", "k", (F.col("k") * 90).alias("l_start"), (F.col("k") * 90 + 40).alias("l_end"))
    return claims, cues


def cue_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim intervals joined with all cues that they overlap."""
    claims, cues = _intervals(spark, sf_dir)
    return RG.overlap_join(claims, cues, "doc_id").select("doc_id", "k", "idx", "overlap")


def best_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue of most overlap for each claim interval."""
    claims, cues = _intervals(spark, sf_dir)
    return RG.best_overlap(claims, cues, "doc_id", ["doc_id", "k"], "idx").select("doc_id", "k", "idx", "overlap")


def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, UD6: extracted claims that are grounded: an interval, an attribute of the document's category, the
    matching form of the text within that of the interval, and a cue that overlaps; with their cues."""
    claims, cues = _intervals(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("category", F.lit("")).alias("category"))
    whole = O.cues(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda e: e["text"]), "").alias("whole"))
    schema = table(spark, sf_dir, "category_schema").select("attribute_id", F.col("category").alias("allowed"), (F.row_number().over(W.orderBy("attribute_id")) - 1).alias("at"))  # a fixed table
    said = claims.withColumn("at", (F.col("k") % 56).cast("int")).join(whole, "doc_id").join(F.broadcast(schema), "at").join(d, "doc_id")
    slice_ = F.substring(F.col("whole"), F.col("l_start") + 1, F.lit(40))
    kind = F.col("k") % 4
    text = F.when(kind == 0, F.concat(F.lit("（"), F.upper(F.substring(slice_, 1, 12)), F.lit(" ！"))).when(kind == 1, F.concat(slice_, F.lit("虚构"))).otherwise(slice_)
    found = said.withColumn("claim_text", text).withColumn("l_start", F.when(kind != 3, F.col("l_start"))).filter("l_start is not null and allowed = category").filter(F.contains(X.normalized(slice_), X.normalized(F.col("claim_text"))))
    met = RG.overlap_join(found.select("doc_id", "k", "attribute_id", "claim_text", "l_start", "l_end"), cues, "doc_id")
    return met.groupBy("doc_id", "k", "attribute_id", "claim_text").agg(F.min("idx").alias("first_cue"), F.max("idx").alias("last_cue"), F.count("*").alias("n_cues"))


def _claims(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "samples")
    rooms = table(spark, sf_dir, "join_split").filter("pair_id is not null").groupBy("pair_id").agg(F.min("room_id").alias("room"))
    t = s.select(F.col("sample_id").alias("id"), "pair_id", F.split_part("pair_id", F.lit("__"), F.lit(1)).alias("product"), F.col("claim.passage").alias("text")).filter("text <> ''")
    return t.join(rooms, "pair_id", "left").withColumn("room", F.coalesce("room", F.lit("")))


def claim_family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal claims of a product and room that contain each other, by their least row."""
    return FA.containment_pairs(_claims(spark, sf_dir), ["product", "room"])


def claim_family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: connected families of claims."""
    return FA.claim_families(_claims(spark, sf_dir), ["product", "room"])


def claim_family_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of families with the kept row by a six-part score; where labels conflict all are demoted."""
    s = table(spark, sf_dir, "samples")
    n = F.coalesce(F.col("evidence_count.params"), F.lit(0)) + F.coalesce(F.col("evidence_count.ocr"), F.lit(0)) + F.coalesce(F.col("evidence_count.vlm"), F.lit(0))
    aligned = F.size(F.filter("reviews", lambda r: F.coalesce(r["relation"].isin("support", "refute"), F.lit(False))))
    facts = s.select(F.col("sample_id").alias("id"), F.col("attribute_name").alias("attribute"), n.alias("n_sources"), aligned.alias("n_aligned"), "y", "pair_id")
    return FA.kept_claims(FA.claim_families(_claims(spark, sf_dir), ["product", "room"]), facts)


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter keys matched with schema names and aliases."""
    keys = table(spark, sf_dir, "samples").select(F.explode("evidence_params").alias("x")).select("x.param_key").distinct()
    schema = table(spark, sf_dir, "category_schema").select("attribute_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    return FA.alias_matches(keys, schema)


def greedy_phrase_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each category with their first representative."""
    m = table(spark, sf_dir, "mentions").filter("mention_type = 'free' and category is not null")
    return FA.greedy_representatives(m.select("category", F.col("evidence_span").alias("phrase")), "category")


def average_linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the schema names and aliases of each category."""
    c = table(spark, sf_dir, "category_schema").select("category", F.explode(F.array_union(F.array("canonical_name"), F.col("aliases"))).alias("name"))
    return FA.clusters(c, "category")


def phrase_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema names of each category merged one after the other; new ids become targets at once."""
    c = table(spark, sf_dir, "category_schema").select("category", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    return FA.sequential_merge(c, "category")


def salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON texts of all events, damaged in four ways and read tolerantly."""
    salvage = F.pandas_udf(FA.salvaged, "string")
    e = table(spark, sf_dir, "events").select("event_id", "props", (F.col("event_id") % 4).alias("kind"))
    p = F.col("props")
    damaged = F.when(F.col("kind") == 0, p).when(F.col("kind") == 1, F.concat(F.lit("text ```json\n"), p, F.lit("\n``` more"))).when(F.col("kind") == 2, F.concat(F.lit("so: "), p, F.lit(" end"))).otherwise(F.concat(F.lit("["), p, F.lit(", "), p, F.lit(', {"k": ')))
    return e.select("event_id", "kind", salvage(damaged).alias("parsed"))


QUERIES = {f.__name__: f for f in (passage_build, fold_mention, cue_offsets, chunk_ranges, cue_overlap, best_cue, grounded_claims, claim_family_pairs, claim_family_components, claim_family_kept, alias_lookup, greedy_phrase_dedupe, average_linkage_clusters, phrase_merges, salvage_json)}

_M = "m as (select distinct product_id, ingested_ts, review_id, attribute_id, polarity, mention_strength, explicit_fact_hit, evidence_span, mention_type from mentions where attribute_id is not null)"
_ORD = "ingested_ts, review_id, attribute_id, polarity, mention_strength, explicit_fact_hit, coalesce(evidence_span, ''), mention_type"
_CH = "list_distinct(list_filter(string_split({}, ''), lambda z: z <> ''))"
NORMAL_FORM = "regexp_replace(lower(translate({}, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')), '[\\s\\-_/()（）·．。，,、:：;；''\"“”‘’!！?？]+', '', 'g')"
_CUE = "c0 as (select doc_id, unnest(regexp_extract_all(text, '(\\d\\d:\\d\\d:\\d\\d[,.]\\d{3}) --> (\\d\\d:\\d\\d:\\d\\d[,.]\\d{3})[^\\n]*\\n([^\\n]*)')) b, unnest(range(0, len(regexp_extract_all(text, '(\\d\\d:\\d\\d:\\d\\d[,.]\\d{3}) --> (\\d\\d:\\d\\d:\\d\\d[,.]\\d{3})[^\\n]*\\n([^\\n]*)')))) idx from documents where contains(text, '-->')), c1 as (select doc_id, idx, b[1:12] s, b[18:29] e, trim(string_split(b, chr(10))[2], ' ') txt from c0), cues as (select doc_id, idx, s[1:2]::double * 3600 + s[4:5]::double * 60 + s[7:8]::double + s[10:12]::double / 1000 start_s, e[1:2]::double * 3600 + e[4:5]::double * 60 + e[7:8]::double + e[10:12]::double / 1000 end_s, (sum(length(txt)) over w - length(txt))::int char_start, (sum(length(txt)) over w)::int char_end, txt from c1 window w as (partition by doc_id order by idx))"
_IV = _CUE + ", tot as (select doc_id, max(char_end) n from cues group by 1 having max(char_end) > 0), cl as (select doc_id, unnest(range(0, ((n - 1) // 90) + 1)) k from tot), ov as (select cl.doc_id, k, idx, least(k * 90 + 40, char_end) - greatest(k * 90, char_start) overlap from cl join cues on cl.doc_id = cues.doc_id where least(k * 90 + 40, char_end) - greatest(k * 90, char_start) > 0)"
_FAM = """rm as (select pair_id, min(room_id) room from join_split where pair_id is not null group by 1), t0 as (select sample_id id, s.pair_id, split_part(s.pair_id, '__', 1) product, coalesce(room, '') room, y, attribute_name, coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0) ns, len(list_filter(coalesce(reviews, []), lambda r: r.relation in ('support', 'refute'))) na, lower(regexp_replace(claim.passage, '\\s+', '', 'g')) x from samples s left join rm on s.pair_id = rm.pair_id where claim.passage <> ''),
 t as (select *, min(id) over (partition by product, room, x) class from t0 where length(x) >= 5), p as (select distinct least(a.class, b.class) a, greatest(a.class, b.class) b from t a join t b on a.product = b.product and a.room = b.room and a.class <> b.class and contains(a.x, b.x)),
 e as (select a, b from p union all select b, a from p), r as (select distinct class id, class root from t union select e.b, r.root from r join e on r.id = e.a), g as (select id, min(root) family from r group by 1), f0 as (select t.id, g.family from t join g on t.class = g.id), f as (select *, count(*) over (partition by family) size from f0)"""
SQL = {
    "passage_build": f"with {_M}, g as (select product_id, attribute_id, list(evidence_span order by {_ORD}) l from m where evidence_span is not null group by 1, 2), d as (select *, string_split(list_reduce(l, lambda acc, x: case when len(list_intersect({_CH.format('string_split(acc, chr(31))[-1]')}, {_CH.format('x')})) / greatest(len(list_distinct(list_concat({_CH.format('string_split(acc, chr(31))[-1]')}, {_CH.format('x')}))), 1) >= 0.9 then acc else acc || chr(31) || x end), chr(31)) kept from g), u as (select *, length(array_to_string(kept, chr(10) || '---' || chr(10))) tot, greatest(1, floor(len(kept) * (500.0::double / length(array_to_string(kept, chr(10) || '---' || chr(10)))))::int) kn from d), z as (select *, case when tot > 600 and len(kept) > 1 then list_transform(list_sort(list_distinct(list_transform(range(0, kn), lambda i: least(len(kept) - 1, floor(i * (len(kept)::double / kn))::int)))), lambda i: kept[i + 1]) else kept end used from u) select product_id, attribute_id, len(l)::int n_all, len(kept)::int n_kept, len(used)::int n_used, array_to_string(used, chr(10) || '---' || chr(10)) passage from z",
    "cue_offsets": f"with {_CUE} select doc_id, idx::int idx, start_s, end_s, char_start, char_end, txt as \"text\" from cues",
    "cue_overlap": f"with {_IV} select doc_id, k::int k, idx::int idx, overlap from ov",
    "fold_mention": f"with {_M}, g as (select product_id, attribute_id, list({{'e': explicit_fact_hit, 's': mention_strength, 'p': polarity, 't': evidence_span}} order by {_ORD}) l from m group by 1, 2), k as (select product_id, attribute_id, list_reduce(l, lambda a, b: case when (not a.e and b.e) or (a.s <> 'strong' and b.s = 'strong') then b else a end) k from g) select product_id, attribute_id, k.e explicit_fact_hit, k.s mention_strength, k.p polarity, k.t evidence_span from k",
    "salvage_json": "select event_id, (event_id % 4)::int kind, case when event_id % 4 = 3 then '[' || props || ', ' || props || ']' else props end parsed from events",
    "grounded_claims": f"""with {_IV}, wh as (select doc_id, string_agg(txt, '' order by idx) whole from cues group by 1), sc as (select attribute_id, category allowed, row_number() over (order by attribute_id) - 1 at_ from category_schema), sd as (select cl.doc_id, k, attribute_id, substr(whole, k * 90 + 1, 40) sl from cl join wh on cl.doc_id = wh.doc_id join sc on at_ = k % 56 join documents d on d.doc_id = cl.doc_id and d.category = allowed where k % 4 <> 3),
 tx as (select *, case when k % 4 = 0 then '（' || upper(substr(sl, 1, 12)) || ' ！' when k % 4 = 1 then sl || '虚构' else sl end claim_text from sd) select tx.doc_id, tx.k::int k, attribute_id, claim_text, min(idx)::int first_cue, max(idx)::int last_cue, count(*) n_cues from tx join ov on tx.doc_id = ov.doc_id and tx.k = ov.k where k_norm(claim_text, sl) group by 1, 2, 3, 4""".replace("k_norm(claim_text, sl)", f"contains({NORMAL_FORM.format('sl')}, {NORMAL_FORM.format('claim_text')})"),
    "greedy_phrase_dedupe": f"""with recursive d as (select distinct category, evidence_span phrase from mentions where mention_type = 'free' and category is not null and evidence_span is not null), k as (select *, {_CH.format('phrase')} c, row_number() over (partition by category order by phrase) i from d),
 w as (select category, 0::bigint i, ''::varchar phrase, ''::varchar rep, []::struct(p varchar, c varchar[])[] hs from (select distinct category from d) union all select category, i, phrase, coalesce(f, phrase), case when f is null then list_append(hs, {{'p': phrase, 'c': c}}) else hs end from (select k.category, k.i, k.phrase, k.c, w.hs, list_filter(w.hs, lambda h: len(list_intersect(h.c, k.c)) / len(list_distinct(list_concat(h.c, k.c))) > 0.8)[1].p f from w join k on k.category = w.category and k.i = w.i + 1))
 select category, phrase, rep representative from w where i > 0""",
    "phrase_merges": """with recursive c as (select distinct category, unnest(list_concat([canonical_name], aliases)) name from category_schema), k as (select *, row_number() over (partition by category order by length(name), name) i from c),
 w as (select category, 0::bigint i, ''::varchar name, ''::varchar target, []::varchar[] ts from (select distinct category from c) union all select k.category, k.i, k.name, case when f is null then k.name else f end, case when f is null then list_append(ts, k.name) else ts end from (select w.category, w.ts, k.i, k.name, case when length(k.name) <> 5 then list_filter(w.ts, lambda t: contains(k.name, t) or contains(t, k.name))[1] end f from w join k on k.category = w.category and k.i = w.i + 1) k)
 select category, name, target from w where i > 0""",
    "best_cue": f"with {_IV}, b as (select *, row_number() over (partition by doc_id, k order by overlap desc, idx) rn from ov) select doc_id, k::int k, idx::int idx, overlap from b where rn = 1",
    "chunk_ranges": f"with recursive {_CUE}, w as (select doc_id, idx, char_start a, char_end z, 0 chunk from cues where idx = 0 union all select c.doc_id, c.idx, case when w.z > w.a and c.char_end - w.a > 400 then c.char_start else w.a end, c.char_end, case when w.z > w.a and c.char_end - w.a > 400 then w.chunk + 1 else w.chunk end from w join cues c on c.doc_id = w.doc_id and c.idx = w.idx + 1) select doc_id, chunk, min(a) as first, max(z) as last from w group by 1, 2 having max(z) > min(a)",
    "claim_family_pairs": f"with recursive {_FAM} select a, b from p",
    "claim_family_components": f"with recursive {_FAM} select id, family, size from f where size > 1",
    "claim_family_kept": f"""with recursive {_FAM}, k as (select f.id, f.family, min(coalesce(y, 0)) over w < max(coalesce(y, 0)) over w conflict, first_value(f.id) over (partition by f.family order by (trim(attribute_name, '<> ') not in ({", ".join(f"'{g}'" for g in FA.GENERIC)})) desc, ns desc, na desc, coalesce((y = 1)::int, 0) desc, length(trim(attribute_name, '<> ')) desc, pair_id desc, f.id desc) kept from f join t on f.id = t.id where f.size > 1 window w as (partition by f.family)) select id, family, conflict, kept, conflict or id <> kept demoted from k""",
    "alias_lookup": "with k as (select distinct x.param_key param_key from (select unnest(evidence_params) x from samples)), kn as (select param_key, regexp_replace(lower(translate(param_key, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ／［］＿', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/[]_')), '[\\s\\-_/()（）·．。，,、:：;；''\"“”‘’!！?？]+', '', 'g') k from k), n as (select distinct attribute_id, regexp_replace(lower(nm), '[\\s\\-_/()（）·．。，,、:：;；''\"“”‘’!！?？]+', '', 'g') p from (select attribute_id, unnest(list_concat([canonical_name], aliases)) nm from category_schema)) select distinct attribute_id, param_key from kn, n where k <> '' and p <> '' and (contains(k, p) or contains(p, k))",
}
