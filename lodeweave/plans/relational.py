"""Relational operators as declared SQL plans over the domain tables.

Each plan names its tables; ``run`` binds them as DataFrames, so that Catalyst sees one logical
plan with pruned columns and pushed-down filters. Ties are always broken by a total order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodeweave.session import table

TABLES = ("samples", "join_split", "mentions", "clips", "products", "category_schema", "documents", "embeddings", "events")


@dataclass(frozen=True)
class Plan:
    """A query: what it is, its Spark SQL and, if it differs, the DuckDB SQL of the check."""

    what: str
    sql: str
    check: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in self.sql}
        return spark.sql(self.sql, **used)

    def oracle(self) -> str:
        text = self.check or self.sql
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        return text


_PAIRS = """pairs as (select pair_id, product_id, attribute_id, category, subcategory, room_id, coverage, confidence, y, c, built_ts,
  row_number() over (partition by pair_id order by built_ts desc, c desc nulls last, room_id desc nulls last, coverage desc, product_id) rn from {join_split})"""
_LABELS = """labels as (select pair_id, y, c, split, sample_id, row_number() over (partition by pair_id order by loaded_ts desc, sample_id desc) rn from {samples})"""
_PRODUCTS = """goods as (select product_id, title, price, shop_name, row_number() over (partition by product_id order by title nulls last, price nulls last, shop_name nulls last) rn from {products})"""
_M = "m as (select distinct review_id, product_id, attribute_id, category, polarity, review_polarity, review_text, evidence_span, mention_type, explicit_fact_hit, mention_strength, review_time, ingested_ts from {mentions})"
_KEY = "ingested_ts, polarity, mention_strength, explicit_fact_hit, coalesce(evidence_span, ''), coalesce(review_time, ''), coalesce(review_polarity, ''), mention_type"

PLANS = {
    "final_join": Plan("J1, U1: pairs and labels inner, products left; the last duplicate wins", f"with {_PAIRS}, {_LABELS}, {_PRODUCTS} select p.pair_id, p.product_id, p.attribute_id, coalesce(p.room_id, 'UNKNOWN') room_id, coalesce(p.coverage, 0) coverage, coalesce(p.confidence, 'absent') confidence, l.y, l.c, coalesce(g.title, '') title from (select * from pairs where rn = 1) p join (select * from labels where rn = 1) l on p.pair_id = l.pair_id left join (select * from goods where rn = 1) g on p.product_id = g.product_id"),
    "clips_with_products": Plan("J2: clips left join products with defaults", f"with {_PRODUCTS} select clip_no, c.product_id, coalesce(g.title, '') title, coalesce(g.price, 0.0) price from {{clips}} c left join (select * from goods where rn = 1) g on c.product_id = g.product_id"),
    "attribute_meta": Plan("J3: attribute name from the schema, the id itself by default", "select m.attribute_id, coalesce(s.canonical_name, m.attribute_id) name, count(*) n from {mentions} m left join {category_schema} s on m.attribute_id = s.attribute_id where m.attribute_id is not null group by 1, 2", "select m.attribute_id, coalesce(s.canonical_name, m.attribute_id) as name, count(*) n from {mentions} m left join {category_schema} s on m.attribute_id = s.attribute_id where m.attribute_id is not null group by 1, 2"),
    "pairs_left_claims": Plan("J5: pairs with the number and length of their claims, claimless pairs kept", "with k as (select pair_id, count(*) n_claims, sum(length(claim.passage)) claim_chars from {samples} where claim.passage <> '' group by pair_id) select distinct j.pair_id, coalesce(k.n_claims, 0) n_claims, coalesce(k.claim_chars, 0) claim_chars from {join_split} j left join k on j.pair_id = k.pair_id"),
    "pairs_left_reviews": Plan("J6: pairs with the number of their distinct mentions", "with k as (select product_id, attribute_id, count(distinct review_id) n from {mentions} group by 1, 2) select distinct j.pair_id, coalesce(k.n, 0) n_reviews from {join_split} j left join k on j.product_id = k.product_id and j.attribute_id = k.attribute_id"),
    "three_evidence_join": Plan("J7, P15: counts of three kinds of evidence beside each other, with coverage", "with p as (select sample_id, count(*) n from {samples} lateral view explode(evidence_params) t as x group by 1), o as (select sample_id, count(*) n from {samples} lateral view explode(evidence_ocr) t as x group by 1), v as (select sample_id, count(*) n from {samples} lateral view explode(evidence_vlm) t as x group by 1) select s.sample_id, coalesce(p.n, 0) params, coalesce(o.n, 0) ocr, coalesce(v.n, 0) vlm, int(p.n is not null) + int(o.n is not null) + int(v.n is not null) coverage from {samples} s left join p on s.sample_id = p.sample_id left join o on s.sample_id = o.sample_id left join v on s.sample_id = v.sample_id", "select sample_id, len(evidence_params) params, len(evidence_ocr) ocr, len(evidence_vlm) vlm, (len(evidence_params) > 0)::int + (len(evidence_ocr) > 0)::int + (len(evidence_vlm) > 0)::int coverage from samples"),
    "queue_drives": Plan("J8: sample pairs met in join_split, and how many are missing", "select case when j.pair_id is null then 'missing' else 'met' end state, count(*) n from {samples} s left join (select distinct pair_id from {join_split}) j on s.pair_id = j.pair_id group by 1"),
    "reviews_drive": Plan("J9: join_split pairs met in the samples, and how many are missing", "select case when s.pair_id is null then 'missing' else 'met' end state, count(*) n from {join_split} j left join (select distinct pair_id from {samples}) s on s.pair_id = j.pair_id group by 1"),
    "anti_existing_pairs": Plan("F18: pairs that the samples do not have", "select distinct j.pair_id, j.category from {join_split} j left anti join {samples} s on j.pair_id = s.pair_id", "select distinct pair_id, category from join_split j where not exists (select 1 from samples s where s.pair_id = j.pair_id)"),
    "valid_attributes": Plan("F4: mentions by whether their attribute is in the schema of their category", "select category, s.attribute_id is not null as valid, count(*) n from (select m.category, m.attribute_id from {mentions} m) m left join (select attribute_id, category cat from {category_schema}) s on m.attribute_id = s.attribute_id and m.category = s.cat group by 1, 2"),
    "mention_filter": Plan("F2: mentions with a text and an attribute that are no feelings", f"with {_M} select review_id, attribute_id, polarity from m where mention_type <> 'feeling' and attribute_id is not null and coalesce(evidence_span, '') <> ''"),
    "eval_leak_filter": Plan("F3: schema names that contain one of the keywords once brackets are stripped", "select attribute_id, canonical_name, exists(array('材质', '保质', '适用'), k -> contains(translate(canonical_name, '<> ', ''), k)) leak from {category_schema}", "select attribute_id, canonical_name, list_bool_or(list_transform(['材质', '保质', '适用'], lambda k: contains(translate(canonical_name, '<> ', ''), k))) leak from category_schema"),
    "missing_claim_risk": Plan("F16: samples without a claim whose reviews hold strong explicit negatives; the first example", "with s as (select sample_id, filter(reviews, r -> r.polarity = 'neg' and r.mention_strength = 'strong' and r.explicit_fact_hit) h from {samples} where not (coalesce(claim.has_claim_srt, false) and (size(coalesce(claim.segments, array())) > 0 or coalesce(claim.passage, '') <> ''))) select sample_id, size(h) hits, h[0].review_id example from s where size(h) > 0", "with s as (select sample_id, list_filter(reviews, lambda r: r.polarity = 'neg' and r.mention_strength = 'strong' and r.explicit_fact_hit) h from samples where not (coalesce(claim.has_claim_srt, false) and (coalesce(len(claim.segments), 0) > 0 or coalesce(claim.passage, '') <> ''))) select sample_id, len(h)::int hits, h[1].review_id example from s where len(h) > 0"),
    "category_index": Plan("S10: products per category, blanks dropped", "select category, count(distinct product_id) n_products, count(*) n_clips from {clips} where trim(category) <> '' group by category"),
    "load_split": Plan("S19: rows with a label, unknown splits to train", "select sample_id, case when split in ('train', 'val', 'test') then split else 'train' end split, y from {samples} where y is not null"),
    "split_override": Plan("S20: test rows replaced by constructed ones", "select sample_id, split from {samples} where split <> 'test' union all select sample_id, 'test' split from {samples} where y = 1 and c >= 0.8"),
    "union_supervised": Plan("U2, U3: supervised and objective-negative rows in one table", "select pair_id, y, c, 'supervised' origin from {samples} where y is not null union all select pair_id, 0 y, round(0.6 * coverage / 3, 4) c, 'objective' origin from (select distinct pair_id, coverage from {join_split}) where coverage > 0"),
    "objective_weight": Plan("G21: weight by coverage with discount and floor", "select distinct pair_id, coverage, greatest(0.05, round(0.6 * case coverage when 3 then 1.0 when 2 then 0.75 when 1 then 0.5 else 0.0 end, 4)) weight from {join_split}", "select distinct pair_id, coverage, greatest(0.05, round(0.6 * case coverage when 3 then 1.0 when 2 then 0.75 when 1 then 0.5 else 0.0 end, 4))::double weight from join_split"),
    "split_leakage": Plan("G17: rooms whose samples carry several splits", "with r as (select pair_id, min(room_id) room_id from {join_split} group by 1), s as (select r.room_id, s.split from {samples} s join r on s.pair_id = r.pair_id where s.split is not null and r.room_id is not null) select room_id, count(distinct split) n_splits, count(*) n_rows from s group by room_id having count(distinct split) > 1"),
    "table1_stats": Plan("G8: rows, positive rate, distinct products and attributes by split, category and coverage in one pass", "with j as (select pair_id, min(category) category, max(coverage) coverage, min(product_id) product_id from {join_split} group by 1) select s.split, j.category, j.coverage, count(*) n, round(avg(s.y), 6) pos_rate, count(distinct j.product_id) products, count(distinct s.attribute_id) attributes from {samples} s join j on s.pair_id = j.pair_id where s.split is not null group by grouping sets ((s.split), (j.category), (j.coverage), ())"),
    "coverage_distribution": Plan("G11: pairs per coverage", "select coverage, count(distinct pair_id) n from {join_split} group by coverage"),
    "dominant_type": Plan("G14: most common mention type of a product and attribute, ties by first seen", "with c as (select product_id, attribute_id, mention_type, count(*) n, min(struct(ingested_ts, review_id)) f from {mentions} where attribute_id is not null group by 1, 2, 3), r as (select *, row_number() over (partition by product_id, attribute_id order by n desc, f, mention_type) rn from c) select product_id, attribute_id, mention_type, n from r where rn = 1", "with c as (select product_id, attribute_id, mention_type, count(*) n, min({{'a': ingested_ts, 'b': review_id}}) f from mentions where attribute_id is not null group by 1, 2, 3), r as (select *, row_number() over (partition by product_id, attribute_id order by n desc, f, mention_type) rn from c) select product_id, attribute_id, mention_type, n from r where rn = 1".replace("{{", "{").replace("}}", "}")),
    "relation_counts": Plan("G18: relations of each sample's reviews", "select sample_id, size(filter(reviews, r -> r.relation = 'support')) support, size(filter(reviews, r -> r.relation = 'refute')) refute, size(filter(reviews, r -> r.relation is null)) unknown from {samples} where reviews is not null", "select sample_id, len(list_filter(reviews, lambda r: r.relation = 'support')) support, len(list_filter(reviews, lambda r: r.relation = 'refute')) refute, len(list_filter(reviews, lambda r: r.relation is null)) unknown from samples where reviews is not null"),
    "seed_mean_sd": Plan("G22: mean and population deviation over folds", "select split, round(avg(c), 6) mean_c, round(stddev_pop(c), 6) sd_c, count(c) n from {samples} where not isnan(c) group by split"),
    "paired_t": Plan("G23: paired difference statistic over attributes of two groups", "with a as (select attribute_id, avg(case when y = 1 then c end) x, avg(case when y = 0 then c end) z from {samples} group by 1), d as (select x - z d from a where x is not null and z is not null) select round(avg(d), 6) mean_d, round(avg(d) / (stddev_pop(d) / sqrt(count(*)) + 1e-9), 4) t, count(*) n from d"),
    "class_weights": Plan("G43, G44: inverse class frequencies and the positive weight", "select round(count(*) / (2.0 * sum(y)), 6) w_pos, round(count(*) / (2.0 * sum(1 - y)), 6) w_neg, least(sum(1 - y) / sum(y), 50.0) pos_weight from {samples} where y is not null", "select round(count(*) / (2.0 * sum(y)), 6) w_pos, round(count(*) / (2.0 * sum(1 - y)), 6) w_neg, least(sum(1 - y) / sum(y), 50.0)::double pos_weight from samples where y is not null"),
    "room_volume": Plan("G40: mentions plus one over the pairs of each room", "with m as (select product_id, attribute_id, count(*) n from {mentions} group by 1, 2) select j.room_id, sum(coalesce(m.n, 0) + 1) volume from (select distinct pair_id, product_id, attribute_id, room_id from {join_split} where room_id is not null) j left join m on j.product_id = m.product_id and j.attribute_id = m.attribute_id group by 1"),
    "overwritten_keys": Plan("G45: pairs that come several times and whether their weight changed", "select pair_id, count(*) n, count(distinct c) n_weights, max(built_ts) last_ts from {join_split} group by pair_id having count(*) > 1"),
    "audit_summary": Plan("G10: counts and mean weights by split and label with subtotals", "select split, y, count(*) n, round(avg(c) + 1e-9, 4) mean_c, sum(case when evidence_count.params + evidence_count.ocr + evidence_count.vlm = 0 then 1 else 0 end) source_zero from {samples} group by rollup(split, y)"),
    "best_mention": Plan("W6: best mention of a product, attribute and review: explicit, strong, negative, long span, first", f"with {_M}, r as (select *, row_number() over (partition by product_id, attribute_id, review_id order by explicit_fact_hit desc, case when mention_strength = 'strong' then 1 else 0 end desc, case when polarity = 'neg' then 1 else 0 end desc, length(coalesce(evidence_span, '')) desc, {_KEY}) rn from m where attribute_id is not null) select product_id, attribute_id, review_id, explicit_fact_hit, mention_strength, polarity, evidence_span from r where rn = 1"),
    "last_review_wins": Plan("W8: the last row per key of an ordered list of inputs", f"with {_PAIRS} select pair_id, c, built_ts from pairs where rn = 1"),
    "first_seen": Plan("W9: first mention of each attribute and span, numbered within the product", f"with {_M}, f as (select *, row_number() over (partition by product_id, attribute_id, evidence_span order by {_KEY}, review_id) rn from m where evidence_span is not null), k as (select product_id, attribute_id, evidence_span, ingested_ts, review_id, polarity, mention_strength, mention_type, row_number() over (partition by product_id order by ingested_ts, review_id, attribute_id nulls last, evidence_span) no from f where rn = 1) select product_id, no, review_id, evidence_span from k"),
    "unique_ids": Plan("W10: ids made unique by a number from the second on", "with k as (select clip_no, product_id, row_number() over (partition by product_id order by clip_no, indexed_ts, aired_ts) rn from (select distinct clip_no, product_id, indexed_ts, aired_ts from {clips})) select clip_no, product_id, case when rn = 1 then product_id else concat(product_id, '_', cast(rn as string)) end uid from k"),
    "family_annotation": Plan("W15, X15: claims with the same text in a product: size, kept row, conflict", "with s as (select sample_id, pair_id, split_part(pair_id, '__', 1) product, lower(regexp_replace(claim.passage, '\\\\s+', '')) key, y, c from {samples} where length(claim.passage) >= 5) select sample_id, concat_ws('|', product, md5(key)) as family, count(*) over (partition by product, key) family_size, first_value(sample_id) over (partition by product, key order by c desc nulls last, sample_id) kept, case when min(y) over (partition by product, key) < max(y) over (partition by product, key) then true else false end conflict from s", "with s as (select sample_id, pair_id, split_part(pair_id, '__', 1) product, lower(regexp_replace(claim.passage, '\\s+', '', 'g')) \"key\", y, c from samples where length(claim.passage) >= 5) select sample_id, product || '|' || md5(\"key\") as family, count(*) over (partition by product, \"key\") family_size, first_value(sample_id) over (partition by product, \"key\" order by c desc nulls last, sample_id) kept, case when min(y) over (partition by product, \"key\") < max(y) over (partition by product, \"key\") then true else false end conflict from s"),
    "representative_rows": Plan("T6, T3: up to eight rows per category by priority of confidence, then weight", "with r as (select *, row_number() over (partition by category order by case confidence when 'high' then 0 when 'medium' then 1 else 2 end, c desc, pair_id) rn from (select distinct pair_id, category, confidence, c from {join_split})) select category, rn, pair_id, confidence, c from r where rn <= 8"),
    "case_top": Plan("T5: best row per attribute, the first six of them", "with r as (select sample_id, attribute_id, c, row_number() over (partition by attribute_id order by c desc, sample_id) rn from {samples} where y = 1) select attribute_id, sample_id, c from r where rn = 1 order by c desc, sample_id limit 6"),
    "few_shot": Plan("T14: eight sure examples of each class by hash order", "with r as (select sample_id, y, c, row_number() over (partition by y order by md5(cast(sample_id as string))) rn from {samples} where split = 'train' and c >= 0.5 and y is not null) select y, rn, sample_id, c from r where rn <= 8", "with r as (select sample_id, y, c, row_number() over (partition by y order by md5(sample_id::varchar)) rn from samples where split = 'train' and c >= 0.5 and y is not null) select y, rn, sample_id, c from r where rn <= 8"),
    "free_phrases": Plan("U4: distinct spans of free mentions, sorted", "select distinct evidence_span phrase from {mentions} where mention_type = 'free' and evidence_span is not null order by phrase"),
    "variant_pairs": Plan("J25: rows of the same product in two attributes of one domain", "with s as (select sample_id, split_part(pair_id, '__', 1) base, attribute_id, y from {samples} where y is not null) select a.sample_id a_id, b.sample_id b_id, a.base, a.y a_y, b.y b_y from s a join s b on a.base = b.base and a.attribute_id < b.attribute_id"),
    "split_lookup": Plan("J27: split of a room from its samples, else by hash", "with r as (select pair_id, min(room_id) room_id from {join_split} group by 1), k as (select r.room_id, min(s.split) split from {samples} s join r on s.pair_id = r.pair_id where s.split is not null group by 1), a as (select distinct room_id from {join_split} where room_id is not null) select a.room_id, coalesce(k.split, case when pmod(conv(substr(md5(a.room_id), 25, 8), 16, 10), 100) < 70 then 'train' when pmod(conv(substr(md5(a.room_id), 25, 8), 16, 10), 100) < 80 then 'val' else 'test' end) split from a left join k on a.room_id = k.room_id", "with r as (select pair_id, min(room_id) room_id from join_split group by 1), k as (select r.room_id, min(s.split) split from samples s join r on s.pair_id = r.pair_id where s.split is not null group by 1), a as (select distinct room_id from join_split where room_id is not null) select a.room_id, coalesce(k.split, case when ('0x' || substr(md5(a.room_id), 25, 8))::bigint % 100 < 70 then 'train' when ('0x' || substr(md5(a.room_id), 25, 8))::bigint % 100 < 80 then 'val' else 'test' end) split from a left join k on a.room_id = k.room_id"),
    "set_difference": Plan("U5, U6: attributes of a category that no sample has", "select category, attribute_id from {category_schema} except select s.category, s.attribute_id from {category_schema} s join {samples} x on s.attribute_id = x.attribute_id where x.split = 'val'"),
    "cache_keys": Plan("X18, S23: content keys of requests and their two-character folders", "select distinct sha2(concat_ws('|', attribute_id, attribute_name), 256) key, substr(sha2(concat_ws('|', attribute_id, attribute_name), 256), 1, 2) folder from {samples}", "select distinct sha256(attribute_id || '|' || attribute_name) \"key\", substr(sha256(attribute_id || '|' || attribute_name), 1, 2) folder from samples"),
    "slim_projection": Plan("P1 to P3, S26: chosen columns and chosen fields of nested arrays", "select s.sample_id, s.pair_id, i, r.review_id, r.polarity from {samples} s lateral view posexplode(transform(reviews, r -> named_struct('review_id', r.review_id, 'polarity', r.polarity))) t as i, r", "select sample_id, pair_id, (i - 1)::int i, reviews[i].review_id review_id, reviews[i].polarity polarity from samples, unnest(range(1, len(reviews) + 1)) t(i)"),
    "alias_blocks": Plan("P16, U7: the first six names and aliases of an attribute, order kept", "select attribute_id, array_join(slice(array_distinct(concat(array(canonical_name), aliases)), 1, 6), '、') names from {category_schema}", "with a as (select attribute_id, list_concat([canonical_name], list_filter(list_distinct(aliases), lambda x: x <> canonical_name)) u, list_concat([canonical_name], aliases) o from category_schema) select attribute_id, array_to_string(list_filter(o, lambda x, i: list_position(o, x) = i)[1:6], '、') names from a"),
    "params_with_title": Plan("P17: parameters with the title as one more, where there is none", "select product_id, title, size(raw_params) n, coalesce(size(map_keys(raw_params)), 0) + int(not map_contains_key(raw_params, '商品名称')) n_with_title from (select distinct product_id, title, price, shop_name, map_entries(raw_params) e, raw_params from (select product_id, title, price, shop_name, raw_params from {products} where raw_params is not null))".replace("distinct product_id, title, price, shop_name, map_entries(raw_params) e, raw_params", "product_id, title, raw_params"), "select product_id, title, cardinality(raw_params)::int n, (cardinality(raw_params) + (not map_contains(raw_params, '商品名称'))::int)::int n_with_title from products where raw_params is not null"),
    "ordered_sources": Plan("P6, P11, P12: evidence texts in source order, empty ones dropped", "select sample_id, i, x.src, x.txt from {samples} lateral view posexplode(filter(concat(transform(evidence_params, p -> named_struct('src', 'param', 'txt', p.raw_text)), transform(evidence_ocr, p -> named_struct('src', 'ocr', 'txt', p.raw_text)), transform(evidence_vlm, p -> named_struct('src', 'vlm', 'txt', p.raw_quote))), e -> e.txt <> '')) t as i, x", "with u as (select sample_id, list_filter(list_concat(list_transform(evidence_params, lambda p: {'src': 'param', 'txt': p.raw_text}), list_transform(evidence_ocr, lambda p: {'src': 'ocr', 'txt': p.raw_text}), list_transform(evidence_vlm, lambda p: {'src': 'vlm', 'txt': p.raw_quote})), lambda e: e.txt <> '') l from samples) select sample_id, (i - 1)::int i, l[i].src src, l[i].txt txt from u, unnest(range(1, len(l) + 1)) t(i)"),
    "claim_tokens": Plan("P14, X35: claim characters up to 384, a mark where there is no claim", "select sample_id, case when coalesce(claim.passage, '') = '' then 1 else least(length(claim.passage), 384) end n_tokens, coalesce(nullif(substr(claim.passage, 1, 384), ''), '[NONE]') flow from {samples}"),
    "soft_labels": Plan("X32, X29: labels shrunk to the base rate by weight, clamped", "with b as (select avg(y) p from {samples} where y is not null) select sample_id, round(least(1.0, greatest(0.0, c * y + (1 - c) * p)), 6) target, round(1 / (1 + exp(-(4 * c - 2))), 6) squashed from {samples}, b where y is not null"),
    "mention_repair": Plan("J10: reviews of a sample with the strength of the best mention of the same product and attribute, order kept", f"with {_M}, b as (select product_id, attribute_id, mention_strength, row_number() over (partition by product_id, attribute_id order by explicit_fact_hit desc, {_KEY}, review_id) rn from m where attribute_id is not null), x as (select sample_id, pair_id, attribute_id, i, r.mention_strength st from {{samples}} lateral view posexplode(reviews) t as i, r), y as (select x.sample_id, x.i, coalesce(b.mention_strength, x.st) st from x left join b on concat('p', b.product_id, '__', b.attribute_id) = x.pair_id and b.rn = 1) select sample_id, array_join(transform(array_sort(collect_list(struct(i, st))), e -> e.st), ',') strengths from y group by sample_id", f"with {_M}, b as (select product_id, attribute_id, mention_strength, row_number() over (partition by product_id, attribute_id order by explicit_fact_hit desc, {_KEY}, review_id) rn from m where attribute_id is not null), x as (select sample_id, pair_id, i, reviews[i].mention_strength st from samples, unnest(range(1, len(reviews) + 1)) t(i)), y as (select x.sample_id, x.i, coalesce(b.mention_strength, x.st) st from x left join b on 'p' || b.product_id || '__' || b.attribute_id = x.pair_id and b.rn = 1) select sample_id, string_agg(st, ',' order by i) strengths from y group by sample_id".replace("{mentions}", "mentions")),
    "labels_with_metadata": Plan("J11: samples joined with pair facts, left joined with the schema's type", f"with {_PAIRS} select s.sample_id, p.category, p.coverage, coalesce(c.value_type, 'text') value_type from {{samples}} s join (select * from pairs where rn = 1) p on s.pair_id = p.pair_id left join {{category_schema}} c on s.attribute_id = c.attribute_id"),
    "safe_merge": Plan("P4: only whitelisted fields filled from the auxiliary row, the ignored split recorded", f"with {_PAIRS} select s.sample_id, coalesce(s.confidence, p.confidence) confidence, coalesce(s.y, p.y) y, s.split, p.rn is not null as had_aux from {{samples}} s left join (select * from pairs where rn = 1) p on s.pair_id = p.pair_id"),
    "dual_view": Plan("P5, P18: given and new label side by side with a constant column", "select sample_id, y y_old, case when size(filter(reviews, r -> r.polarity = 'neg' and r.relation is not null)) > 0 then 1 else 0 end y_new, 'params_ocr' policy from {samples}", "select sample_id, y y_old, case when len(list_filter(reviews, lambda r: r.polarity = 'neg' and r.relation is not null)) > 0 then 1 else 0 end y_new, 'params_ocr' as policy from samples"),
    "pair_ids": Plan("X14, X10: pair id where it is missing, prefix of the category", "select distinct pair_id, coalesce(nullif(if(coverage = 1, '', pair_id), ''), concat('p', product_id, '__', attribute_id)) rebuilt, coalesce(map('食品', 'FOOD', '美妆', 'BEAUTY', '服饰', 'APPAREL')[category], upper(split_part(attribute_id, '_', 1))) prefix from {join_split}", "select distinct pair_id, coalesce(nullif(case when coverage = 1 then '' else pair_id end, ''), 'p' || product_id || '__' || attribute_id) rebuilt, case category when '食品' then 'FOOD' when '美妆' then 'BEAUTY' when '服饰' then 'APPAREL' else upper(split_part(attribute_id, '_', 1)) end prefix from join_split"),
    "number_extract": Plan("X12: numbers before a money unit in review texts, least and most", "select review_id, array_min(v) least, array_max(v) most from (select distinct review_id, transform(regexp_extract_all(review_text, '([0-9]+(?:[.][0-9]+)?)(?:元|块)', 1), x -> cast(x as double)) v from {mentions}) where size(v) > 0", "select distinct review_id, list_min(v) least, list_max(v) most from (select review_id, list_transform(regexp_extract_all(review_text, '([0-9]+(?:[.][0-9]+)?)(?:元|块)', 1), lambda x: x::double) v from mentions) where len(v) > 0"),
    "scaled_weights": Plan("X33: weights of rows without sources and with many scaled", "select sample_id, round(c * case when evidence_count.params + evidence_count.ocr + evidence_count.vlm = 0 then 0.5 else 1.0 end * case when evidence_count.params + evidence_count.ocr + evidence_count.vlm >= 8 then 1.2 else 1.0 end, 6) w from {samples}"),
    "real_keys": Plan("X39: matched keys kept only where the product has them, with the real values", "with k as (select product_id, explode(raw_params) as (k, v) from {products} where raw_params is not null) select distinct k.product_id, k.k, k.v from k left semi join {category_schema} s on k.k = s.canonical_name", "with k as (select product_id, unnest(map_entries(raw_params)) e from products where raw_params is not null) select distinct product_id, e.key k, e.value v from k where exists (select 1 from category_schema s where s.canonical_name = e.key)"),
    "attribute_scope": Plan("F17: scope by ordered predicates", "select attribute_id, case when contains(canonical_name, '服务') then 'service' when source = 'review' then 'subjective' else 'product' end scope from {category_schema}"),
    "contrast_eligible": Plan("F15, F14: rows that may serve as contrast", "select sample_id, coalesce(contrastive_mask, false) and y is not null and c >= 0.2 and coalesce(claim.passage, '') <> '' eligible from {samples}"),
    "first_examples": Plan("T16: the first twenty rows of a report", "select sample_id, pair_id from {samples} where y = 1 order by sample_id limit 20"),
    "pair_time": Plan("G41: earliest review time of each sample", "select sample_id, min(coalesce(try_to_timestamp(r.review_time, 'yyyy/M/d H:m:s'), try_to_timestamp(r.review_time, 'yyyy-M-d H:m:s'), try_to_timestamp(r.review_time, 'yyyy/M/d'))) first_ts from {samples} lateral view explode(reviews) t as r group by 1", "select sample_id, min(coalesce(try_strptime(r.review_time, '%Y/%m/%d %H:%M:%S'), try_strptime(r.review_time, '%Y-%m-%d %H:%M:%S'), try_strptime(r.review_time, '%Y/%m/%d'))) first_ts from (select sample_id, unnest(reviews) r from samples) group by 1"),
    "counterfactual_summary": Plan("G39: pairs of variants, both right, and the ids of one class", "with s as (select split_part(pair_id, '__', 1) base, min(y) lo, max(y) hi, count(*) n, avg(c) c from {samples} where y is not null group by 1 having count(*) > 1) select count(*) n_pairs, sum(int(lo < hi)) n_apart, round(avg(c), 6) mean_c from s", "with s as (select split_part(pair_id, '__', 1) base, min(y) lo, max(y) hi, count(*) n, avg(c) c from samples where y is not null group by 1 having count(*) > 1) select count(*) n_pairs, sum((lo < hi)::int)::bigint n_apart, round(avg(c), 6) mean_c from s"),
    "label_noise": Plan("G10, G9: agreement of label and review polarity by confidence", "select confidence, count(*) n, sum(case when (y = 1) = exists(reviews, r -> r.polarity = 'neg') then 1 else 0 end) agree from {samples} where y is not null and reviews is not null group by confidence", "select confidence, count(*) n, sum(case when (y = 1) = (len(list_filter(reviews, lambda r: r.polarity = 'neg')) > 0) then 1 else 0 end)::bigint agree from samples where y is not null and reviews is not null group by confidence"),
}
