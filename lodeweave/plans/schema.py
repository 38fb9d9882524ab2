"""Plans over products, schemas and candidate attributes: bundles, value types, resolution, triage.

Distinct values are counted before they are shuffled by their key, so that a key of many rows costs
as much as its different values. Lists keep first-seen order, ties are broken by the value itself.
"""

from __future__ import annotations

from lodeweave.plans.relational import Plan

# The words of a yes-or-no parameter, and the keywords that mark a leaking name.
YES_NO = "('是', '否', '有', '无', 'true', 'false', '支持', '不支持')"
LEAKS = ("材质", "保质", "适用")
# Fixed value: characters that key matching ignores.
_IGNORED = r"[\s\-_/()（）·．。，,、:：;；'\"“”‘’!！?？]+"
_NUMERIC = r"^\s*[0-9.]+\s*([a-zA-Z一-龥%/]+)?\s*$"
_spark = lambda pattern: pattern.replace("\\", "\\\\").replace("'", "\\'")
_duck = lambda pattern: pattern.replace('\\"', '"').replace("'", "''")


def _types(source: str, keys: str, pattern: str, engine: str) -> str:
    """Value type of each key from its values with their numbers (source: keys, v, n): numeric with the
    commonest unit, boolean, enum of few values that repeat, else text."""
    if engine == "spark":
        unit, listed = f"regexp_extract(v, '{pattern}', 1)", "array_join(array_sort(collect_list(case when r <= 12 then v end)), ',')"
        test = f"v rlike '{pattern}'"
    else:
        unit, listed = f"regexp_extract(v, '{pattern}', 1)", "string_agg(v, ',' order by v) filter (r <= 12)"
        test = f"regexp_matches(v, '{pattern}')"
    return f"""clean as (select {keys}, trim(v) v, sum(n) n from {source} where trim(v) <> '' and lower(trim(v)) <> 'nan' group by {keys}, trim(v)),
 marked as (select *, {test} is_number, {unit} unit, row_number() over (partition by {keys} order by v) r from clean),
 units as (select {keys}, unit, row_number() over (partition by {keys} order by sum(n) desc, unit) r from marked where is_number and unit <> '' group by {keys}, unit),
 told as (select {keys}, sum(n) n, count(*) different, min(case when is_number then 1 else 0 end) numeric_all, min(case when v in {YES_NO} then 1 else 0 end) boolean_all, {listed} listed from marked group by {keys}),
 types as (select t.*, case when numeric_all = 1 and n >= 2 then case when u.unit is not null then concat('numeric:', u.unit) else 'numeric' end when boolean_all = 1 then 'boolean' when different <= greatest(2, floor(0.3 * n)) and different <= 12 then concat('enum:[', listed, ']') else 'text' end kind
  from told t left join units u on {" and ".join(f"t.{k} = u.{k}" for k in keys.split(", "))} and u.r = 1)"""


_PARAMS = """raw as (select distinct product_id, title, price, shop_name, product_url, map_entries(raw_params) e from {products} where raw_params is not null),
 p as (select product_id, x.key k, x.value v from raw lateral view explode(e) t as x)"""
_PARAMS_DUCK = """raw as (select distinct product_id, title, price, shop_name, product_url, map_entries(raw_params) e from products where raw_params is not null),
 p as (select product_id, x.key k, x.value v from (select product_id, unnest(e) x from raw))"""
_CATEGORY = "cats as (select product_id, min(category) category from {clips} where trim(category) <> '' group by product_id)"
_WIDTH = "translate({}, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"
_NORM = f"regexp_replace(lower({_WIDTH.format('k')}), '{_spark(_IGNORED)}', '')"
_NORM_DUCK = f"regexp_replace(lower({_WIDTH.format('k')}), '{_duck(_IGNORED)}', '', 'g')"
_leak = lambda name: "(" + " or ".join(f"contains(translate({name}, '<> ', ''), '{k}')" for k in LEAKS) + ")"
# Order in which kinds of images are chosen, and the kinds that are read by OCR.
_PRIORITY = "case doc_kind when 'detail_page' then 0 when 'review_digest' then 1 when 'transcript' then 2 else 99 end"
_TEXT_KINDS = "('ocr_page', 'param_sheet')"

PLANS: dict[str, Plan] = {
    "value_types": Plan(
        "G46: type of a parameter key's values: numeric with its unit, boolean, enum with its values, or text",
        f"with {_PARAMS}, counted as (select k, v, count(*) n from p group by 1, 2), {_types('counted', 'k', _spark(_NUMERIC), 'spark')} select k, n, different, kind from types",
        f"with {_PARAMS_DUCK}, counted as (select k, v, count(*) n from p group by 1, 2), {_types('counted', 'k', _duck(_NUMERIC), 'duck')} select k, n::bigint n, different, kind from types",
    ),
    "schema_keys": Plan(
        "G13: attributes of a category: parameter keys of one matching form together, the longest key as name, all keys as aliases, type from all their values",
        f"""with {_PARAMS}, {_CATEGORY}, counted as (select category, {_NORM} cluster, k, v, count(*) n from p join cats on p.product_id = cats.product_id where trim(k) <> '' group by 1, 2, 3, 4),
 names as (select category, cluster, k, sum(n) m from counted group by 1, 2, 3), best as (select category, cluster, max_by(k, struct(length(k), k)) canonical, count(*) n_keys, array_join(array_sort(collect_list(k)), '|') aliases from names group by 1, 2), {_types('counted', 'category, cluster', _spark(_NUMERIC), 'spark')}
 select b.category, b.cluster, b.canonical, b.aliases, b.n_keys, t.n, t.kind from best b join types t on b.category = t.category and b.cluster = t.cluster""",
        f"""with {_PARAMS_DUCK}, {_CATEGORY}, counted as (select category, {_NORM_DUCK} cluster, k, v, count(*) n from p join cats using (product_id) where trim(k) <> '' group by 1, 2, 3, 4),
 names as (select distinct category, cluster, k from counted), ranked as (select *, row_number() over (partition by category, cluster order by length(k) desc, k desc) r from names), best as (select category, cluster, max(k) filter (r = 1) canonical, count(*) n_keys, string_agg(k, '|' order by k) aliases from ranked group by 1, 2), {_types('counted', 'category, cluster', _duck(_NUMERIC), 'duck')}
 select b.category, b.cluster, b.canonical, b.aliases, b.n_keys, t.n::bigint n, t.kind from best b join types t on b.category = t.category and b.cluster = t.cluster""",
    ),
    "candidate_attributes": Plan(
        "G12: candidate attributes of a product with the metadata seen first, leaking names left out, beside the mean number of all products",
        f"""with names as (select attribute_id, min(canonical_name) name from {{category_schema}} group by 1), seen as (select product_id, attribute_id, min(struct(ingested_ts, mention_type)) first from {{mentions}} where attribute_id is not null group by 1, 2),
 kept as (select s.product_id, s.attribute_id, s.first.mention_type first_type, coalesce(n.name, s.attribute_id) name from seen s left join names n on s.attribute_id = n.attribute_id where not {_leak("coalesce(n.name, s.attribute_id)")}),
 sets as (select product_id, count(*) n_attributes, array_join(array_sort(collect_list(concat(attribute_id, '=', name, '/', first_type))), ',') attributes from kept group by 1)
 select product_id, n_attributes, attributes, round(m.mean, 6) mean_attributes from sets cross join (select avg(n_attributes) mean from sets) m""",
        f"""with names as (select attribute_id, min(canonical_name) name from category_schema group by 1), seen as (select product_id, attribute_id, mention_type, row_number() over (partition by product_id, attribute_id order by ingested_ts, mention_type) r from mentions where attribute_id is not null),
 kept as (select s.product_id, s.attribute_id, mention_type first_type, coalesce(n.name, s.attribute_id) name from seen s left join names n using (attribute_id) where r = 1 and not {_leak("coalesce(n.name, s.attribute_id)")}),
 sets as (select product_id, count(*) n_attributes, string_agg(attribute_id || '=' || name || '/' || first_type, ',' order by attribute_id || '=' || name || '/' || first_type) attributes from kept group by 1)
 select *, round((select avg(n_attributes) from sets), 6) mean_attributes from sets""",
    ),
    "product_rooms": Plan(
        "S9: product bundle: last non-empty category, first room, distinct paths in first-seen order, title and price of the product",
        """with c as (select distinct * from {clips}), cats as (select product_id, max_by(category, struct(indexed_ts, clip_no)) filter (where trim(category) <> '') category, min_by(room_id, struct(indexed_ts, clip_no)) filter (where coalesce(room_id, '') <> '') room_id from c group by product_id),
 s as (select product_id, srt_path, min(struct(indexed_ts, clip_no)) f from c where srt_path is not null group by 1, 2), sl as (select product_id, array_join(transform(array_sort(collect_list(struct(f, srt_path))), x -> x.srt_path), '|') srt_paths from s group by 1),
 r as (select product_id, review_path, min(struct(indexed_ts, clip_no)) f from c where review_path is not null group by 1, 2), rl as (select product_id, array_join(transform(array_sort(collect_list(struct(f, review_path))), x -> x.review_path), '|') review_paths from r group by 1),
 g as (select product_id, min_by(title, struct(title is null, title)) title from {products} group by 1)
 select cats.product_id, cats.category, coalesce(cats.room_id, 'UNKNOWN') room_id, coalesce(sl.srt_paths, '') srt_paths, coalesce(rl.review_paths, '') review_paths, coalesce(g.title, '') title from cats left join sl on cats.product_id = sl.product_id left join rl on cats.product_id = rl.product_id left join g on cats.product_id = g.product_id""",
        """with c as (select distinct * from clips), cats as (select product_id, arg_max(category, (indexed_ts, clip_no)) filter (trim(category) <> '') category, arg_min(room_id, (indexed_ts, clip_no)) filter (coalesce(room_id, '') <> '') room_id from c group by 1),
 s as (select product_id, srt_path, min((indexed_ts, clip_no)) f from c where srt_path is not null group by 1, 2), sl as (select product_id, string_agg(srt_path, '|' order by f, srt_path) srt_paths from s group by 1),
 r as (select product_id, review_path, min((indexed_ts, clip_no)) f from c where review_path is not null group by 1, 2), rl as (select product_id, string_agg(review_path, '|' order by f, review_path) review_paths from r group by 1),
 g as (select product_id, min(title) title from products group by 1)
 select cats.product_id, cats.category, coalesce(cats.room_id, 'UNKNOWN') room_id, coalesce(sl.srt_paths, '') srt_paths, coalesce(rl.review_paths, '') review_paths, coalesce(g.title, '') title from cats left join sl using (product_id) left join rl using (product_id) left join g using (product_id)""",
    ),
    "free_resolution": Plan(
        "J4: free spans left-joined by category and phrase with the attribute of the longest name or alias that they contain, the rest diverted",
        """with f as (select distinct review_id, category, evidence_span from {mentions} where mention_type = 'free' and evidence_span is not null), n as (select distinct category, attribute_id, name from (select category, attribute_id, explode(concat(array(canonical_name), coalesce(aliases, array()))) name from {category_schema}) where name <> ''),
 h as (select p.category, p.evidence_span, max_by(n.attribute_id, struct(length(n.name), -n.rank)) attribute_id from (select distinct category, evidence_span from f) p join (select *, row_number() over (partition by category order by attribute_id) rank from n) n on p.category = n.category and contains(p.evidence_span, n.name) group by 1, 2),
 r as (select f.review_id, f.evidence_span, min(h.attribute_id) attribute_id from f left join h on f.category = h.category and f.evidence_span = h.evidence_span group by 1, 2) select review_id, evidence_span, coalesce(attribute_id, 'UNRESOLVED') attribute_id from r""",
        """with n as (select category, attribute_id, unnest(list_distinct(list_concat([canonical_name], coalesce(aliases, [])))) name from category_schema), f as (select distinct review_id, category, evidence_span from mentions where mention_type = 'free' and evidence_span is not null),
 h as (select f.*, n.attribute_id, row_number() over (partition by review_id, f.category, evidence_span order by length(name) desc nulls last, n.attribute_id) r from f left join n on f.category = n.category and name <> '' and contains(evidence_span, name))
 select review_id, evidence_span, coalesce(min(attribute_id), 'UNRESOLVED') attribute_id from h where r = 1 group by 1, 2""",
    ),
    "validated_groups": Plan(
        "C2: groups proposed in batches of eighty names: unknown ids are ignored, each id stays in its first group, what no group has stands alone",
        """with named as (select attribute_id, canonical_name, (row_number() over (order by attribute_id) - 1) div 80 batch from {category_schema}), said as (select batch, canonical_name g, attribute_id id from named union all select batch, canonical_name, concat(attribute_id, '?') from named union all select a.batch, a.canonical_name, b.attribute_id from named a join named b on a.batch = b.batch and a.attribute_id <> b.attribute_id and substr(a.canonical_name, 1, 2) = substr(b.canonical_name, 1, 2)),
 valid as (select s.batch, s.g, s.id from said s left semi join named n on s.batch = n.batch and s.id = n.attribute_id), first as (select batch, id, min(g) g from valid group by 1, 2) select n.attribute_id, coalesce(f.g, n.attribute_id) grp from named n left join first f on n.batch = f.batch and n.attribute_id = f.id""",
        """with named as (select attribute_id, canonical_name, (row_number() over (order by attribute_id) - 1) // 80 batch from category_schema) select a.attribute_id, min(b.canonical_name) grp from named a join named b on a.batch = b.batch and substr(a.canonical_name, 1, 2) = substr(b.canonical_name, 1, 2) group by 1""",
    ),
    "image_records": Plan(
        "S25, T6: pages of a product with their kind, those to be read by OCR, and up to eight representatives of the others by priority and order",
        f"""with d as (select product_id, doc_id, doc_kind from {{documents}} where product_id is not null), r as (select *, row_number() over (partition by product_id, doc_kind in {_TEXT_KINDS} order by {_PRIORITY}, doc_id) place from d)
 select product_id, count(*) n_images, array_join(transform(array_sort(collect_list(struct(doc_id, doc_kind))), x -> concat(x.doc_id, ':', x.doc_kind)), ',') images, array_join(array_sort(collect_list(case when doc_kind in {_TEXT_KINDS} then doc_id end)), ',') ocr_images, array_join(transform(array_sort(collect_list(case when doc_kind not in {_TEXT_KINDS} and place <= 8 then struct(place, doc_id) end)), x -> x.doc_id), ',') rep_images from r group by product_id""",
        f"""with d as (select product_id, doc_id, doc_kind from documents where product_id is not null), r as (select *, row_number() over (partition by product_id, doc_kind in {_TEXT_KINDS} order by {_PRIORITY}, doc_id) place from d)
 select product_id, count(*) n_images, string_agg(doc_id || ':' || doc_kind, ',' order by doc_id) images, coalesce(string_agg(doc_id::varchar, ',' order by doc_id) filter (doc_kind in {_TEXT_KINDS}), '') ocr_images, coalesce(string_agg(doc_id::varchar, ',' order by place) filter (doc_kind not in {_TEXT_KINDS} and place <= 8), '') rep_images from r group by 1""",
    ),
    "path_keys": Plan(
        "S11, S13: paths re-rooted at their data segment where that file is known, unchanged where it is not; cache keys get the new path beside the old one",
        """with known as (select distinct srt_path from {clips} where srt_path is not null and length(srt_path) % 3 > 0), old as (select distinct clip_no, concat('D:\\\\old\\\\', replace(srt_path, '/', '\\\\')) p from {clips} where srt_path is not null),
 n as (select clip_no, p, regexp_extract(replace(p, '\\\\', '/'), '(?:^|/)(data/.*)$', 1) q from old) select n.clip_no, coalesce(k.srt_path, n.p) resolved, array_join(array_distinct(array(n.p, coalesce(k.srt_path, n.p))), '|') cache_keys from n left join known k on n.q = k.srt_path""",
        """with old as (select distinct clip_no, srt_path, 'D:\\old\\' || replace(srt_path, '/', '\\') p from clips where srt_path is not null) select clip_no, case when length(srt_path) % 3 > 0 then srt_path else p end resolved, case when length(srt_path) % 3 > 0 then p || '|' || srt_path else p end cache_keys from old""",
    ),
    "chosen_products": Plan(
        "F20: products of a category in order of their id, a limited number of them",
        """with c as (select product_id, max(category) category, count(*) n_clips from {clips} group by 1) select product_id, category, n_clips from c where category = '食品' order by product_id limit 25""",
        """select product_id, max(category) category, count(*) n_clips from clips group by 1 having max(category) = '食品' order by product_id limit 25""",
    ),
    "campaign_jobs": Plan(
        "M19: job list of a campaign: every category held out, each variant and seed, without the jobs whose results are there",
        """with folds as (select distinct category fold from {category_schema}), grid as (select fold, variant, seed from folds lateral view explode(array('full', 'no_retrieval', 'claim_only', 'evidence_only')) a as variant lateral view explode(sequence(0, 4)) b as seed),
 done as (select distinct category fold, 'full' variant, int(pmod(clip_no, 5)) seed from {clips} where category is not null) select g.fold, g.variant, g.seed, concat_ws('_', g.fold, g.variant, concat('s', g.seed)) tag from grid g left anti join done d on g.fold = d.fold and g.variant = d.variant and g.seed = d.seed""",
        """with grid as (select * from (select distinct category fold from category_schema), (select unnest(['full', 'no_retrieval', 'claim_only', 'evidence_only']) variant), (select unnest(range(0, 5)) seed)) select fold, variant, seed::int seed, fold || '_' || variant || '_s' || seed tag from grid g where variant <> 'full' or not exists (select 1 from clips c where c.category = g.fold and c.clip_no % 5 = g.seed)""",
    ),
    "schedule_steps": Plan(
        "W13: factor of the learning rate with a tenth of the steps to warm up and a linear decay, one step for each training row in order",
        """with n as (select count(*) total from {samples} where split = 'train') select step, round(case when step < greatest(1, total div 10) then step / greatest(1, total div 10) else greatest(0.0, (total - step) / greatest(1, total - total div 10)) end, 6) factor from n lateral view explode(sequence(0, total - 1)) t as step""",
        """with n as (select count(*) total from samples where split = 'train') select step, round(case when step < greatest(1, total // 10) then step / greatest(1, total // 10) else greatest(0.0, (total - step) / greatest(1, total - total // 10)) end, 6) factor from n, unnest(range(0, total)) t(step)""",
    ),
}
