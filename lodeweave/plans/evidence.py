"""Plans over a sample's evidence: renderings, routing, policies, items, attribution.

Each plan has the Spark SQL and the DuckDB SQL of its check, written separately from the meaning of
the operator. NULL arrays count as empty throughout; texts are used whole unless the plan shortens them.
"""

from __future__ import annotations

from lodeweave.plans.relational import Plan

# Terms of risk and of support in argument texts.
RISK = ("无法验证", "缺乏", "没有提供", "未提供", "不确定", "冲突", "不一致", "无法确认", "缺少", "风险", "夸大", "未标注", "无依据")
SUPPORT = ("直接支持", "相符", "一致", "吻合", "明确显示", "证据显示")
# Names of evidence policies and the sources that they choose.
POLICIES = {"no_args": "params,ocr,vlm", "source_only": "params,ocr,vlm", "sources_only": "params,ocr,vlm", "args_first": "params,ocr,vlm", "source_first": "params,ocr,vlm", "": "params,ocr,vlm", "args_only": "args", "params_only": "params", "ocr_only": "ocr", "vlm_only": "vlm", "params_args": "params", "ocr_args": "ocr", "vlm_args": "vlm"}

_list = lambda terms: "array(" + ", ".join(f"'{t}'" for t in terms) + ")"
_duck = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
_POLICY = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in POLICIES.items()) + ")"
_POLICY_DUCK = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in POLICIES.items()) + "}"

# The three arguments of a sample are the distinct reasons of its supporting, refuting and other reviews.
_ARGS = """args as (select sample_id,
  concat_ws('\n', array_sort(array_distinct(transform(filter(reviews, r -> r.relation = 'support' and r.reason <> ''), r -> r.reason)))) sup,
  concat_ws('\n', array_sort(array_distinct(transform(filter(reviews, r -> r.relation = 'refute' and r.reason <> ''), r -> r.reason)))) ref,
  concat_ws('\n', array_sort(array_distinct(transform(filter(reviews, r -> r.relation is null and r.reason <> ''), r -> r.reason)))) gap from {samples})"""
_ARGS_DUCK = """rs as (select sample_id, unnest(reviews, recursive := true) from samples),
 a0 as (select sample_id, string_agg(distinct reason, chr(10) order by reason) filter (relation = 'support' and reason <> '') sup,
  string_agg(distinct reason, chr(10) order by reason) filter (relation = 'refute' and reason <> '') ref,
  string_agg(distinct reason, chr(10) order by reason) filter (relation is null and reason <> '') gap from rs group by 1),
 args as (select s.sample_id, coalesce(sup, '') sup, coalesce(ref, '') ref, coalesce(gap, '') gap from samples s left join a0 on s.sample_id = a0.sample_id)"""
# One array of (source, text) in source order: the blocks from which policies choose.
_BLOCKS = """concat(transform(filter(coalesce(evidence_params, array()), p -> p.raw_text <> ''), p -> named_struct('src', 'params', 'txt', p.raw_text)),
  transform(filter(coalesce(evidence_ocr, array()), p -> p.raw_text <> ''), p -> named_struct('src', 'ocr', 'txt', p.raw_text)),
  transform(filter(coalesce(evidence_vlm, array()), p -> p.raw_quote <> ''), p -> named_struct('src', 'vlm', 'txt', p.raw_quote)))"""
_BLOCKS_DUCK = """pieces as (select sample_id, 1 o, i, 'params' src, evidence_params[i].raw_text txt from samples, unnest(range(1, len(evidence_params) + 1)) t(i)
 union all select sample_id, 2, i, 'ocr', evidence_ocr[i].raw_text from samples, unnest(range(1, len(evidence_ocr) + 1)) t(i)
 union all select sample_id, 3, i, 'vlm', evidence_vlm[i].raw_quote from samples, unnest(range(1, len(evidence_vlm) + 1)) t(i))"""
# A policy for each row from a list of names, by its id.
_MIX = ("sources_only", "params_only", "ocr_only", "vlm_only", "args_only")

PLANS: dict[str, Plan] = {
    "evidence_text": Plan(
        "P7 to P10: whole claim and evidence texts, the shortened rendering and the display with source tags",
        """select sample_id,
 trim(concat_ws(' ', attribute_name, array_join(transform(filter(coalesce(claim.segments, array()), s -> s.text <> ''), s -> s.text), ' '))) claim_text,
 trim(concat_ws(' ', array_join(filter(concat(array(attribute_name), transform(evidence_params, x -> x.raw_text), transform(evidence_ocr, x -> x.raw_text), transform(evidence_vlm, x -> x.raw_quote)), t -> t <> ''), ' '))) evidence_text,
 case when length(array_join(transform(evidence_params, x -> concat(x.param_key, ':', x.raw_text)), ' ')) > 300 then concat(substr(array_join(transform(evidence_params, x -> concat(x.param_key, ':', x.raw_text)), ' '), 1, 300), '...') else array_join(transform(evidence_params, x -> concat(x.param_key, ':', x.raw_text)), ' ') end rendered,
 coalesce(nullif(array_join(concat(transform(filter(evidence_params, x -> x.raw_text <> ''), x -> concat('[参数] ', trim(x.raw_text))), transform(filter(evidence_ocr, x -> x.raw_text <> ''), x -> concat('[详情图] ', trim(x.raw_text))), transform(filter(evidence_vlm, x -> x.raw_quote <> ''), x -> concat('[视觉] ', trim(x.raw_quote)))), '  '), ''), '（无可核验商品事实）') shown
 from {samples}""",
        f"""with {_BLOCKS_DUCK},
 e as (select sample_id, string_agg(txt, ' ' order by o, i) filter (txt <> '') t, string_agg(case src when 'params' then '[参数] ' when 'ocr' then '[详情图] ' else '[视觉] ' end || trim(txt, ' '), '  ' order by o, i) filter (txt <> '') d from pieces group by 1),
 k as (select sample_id, string_agg(evidence_params[i].param_key || ':' || evidence_params[i].raw_text, ' ' order by i) r from samples, unnest(range(1, len(evidence_params) + 1)) t(i) group by 1),
 g as (select sample_id, string_agg(claim.segments[i].text, ' ' order by i) filter (claim.segments[i].text <> '') t from samples, unnest(range(1, len(claim.segments) + 1)) t(i) group by 1)
 select s.sample_id, trim(concat_ws(' ', attribute_name, coalesce(g.t, '')), ' ') claim_text, trim(concat_ws(' ', nullif(attribute_name, ''), e.t), ' ') evidence_text,
 case when length(k.r) > 300 then substr(k.r, 1, 300) || '...' else coalesce(k.r, '') end rendered, coalesce(nullif(e.d, ''), '（无可核验商品事实）') shown
 from samples s left join e on s.sample_id = e.sample_id left join k on s.sample_id = k.sample_id left join g on s.sample_id = g.sample_id""",
    ),
    "evidence_routing": Plan(
        "P6: each mention's text goes to the payload of its source type: params and title, OCR, VLM; an unknown type to params; an empty text nowhere",
        """with m as (select distinct review_id, product_id, attribute_id, mention_type, trim(coalesce(evidence_span, '')) t, case when mention_type = 'fact' then 'params' when mention_type = 'feeling' and polarity = 'pos' then 'detail_image_ocr' when mention_type = 'feeling' and polarity = 'neg' then 'detail_image_vlm' when mention_type = 'free' and polarity = 'pos' then 'product_title' else mention_type end src from {mentions})
 select review_id, product_id, attribute_id, mention_type, src, t span, case when t <> '' and src not in ('detail_image_ocr', 'detail_image_vlm') then t end params, case when t <> '' and src = 'detail_image_ocr' then t end ocr, case when t <> '' and src = 'detail_image_vlm' then t end vlm from m""",
        """with m as (select distinct review_id, product_id, attribute_id, mention_type, trim(coalesce(evidence_span, ''), ' ') t, case when mention_type = 'fact' then 'params' when mention_type = 'feeling' and polarity = 'pos' then 'detail_image_ocr' when mention_type = 'feeling' and polarity = 'neg' then 'detail_image_vlm' when mention_type = 'free' and polarity = 'pos' then 'product_title' else mention_type end src from mentions),
 r as (select *, case when t = '' then 'none' when src in ('params', 'product_title') then 'params' when src = 'detail_image_ocr' then 'ocr' when src = 'detail_image_vlm' then 'vlm' else 'params' end dest from m)
 select review_id, product_id, attribute_id, mention_type, src, t span, case when dest = 'params' then t end params, case when dest = 'ocr' then t end ocr, case when dest = 'vlm' then t end vlm from r""",
    ),
    "argument_blocks": Plan(
        "P13: the three argument fields as tagged blocks in order, empty ones left out",
        f"""with {_ARGS} select sample_id, i, b.tag, b.txt from args lateral view posexplode(filter(array(named_struct('tag', '[ARG_SUP]', 'txt', sup), named_struct('tag', '[ARG_REF]', 'txt', ref), named_struct('tag', '[ARG_GAP]', 'txt', gap)), x -> x.txt <> '')) t as i, b""",
        f"""with {_ARGS_DUCK}, u as (select sample_id, 0 o, '[ARG_SUP]' tag, sup txt from args union all select sample_id, 1, '[ARG_REF]', ref from args union all select sample_id, 2, '[ARG_GAP]', gap from args) select sample_id, (row_number() over (partition by sample_id order by o) - 1)::int i, tag, txt from u where txt <> ''""",
    ),
    "term_scores": Plan(
        "G42, X13: how many terms of risk and of support a sample's arguments hold",
        f"""with {_ARGS} select sample_id, size(filter({_list(RISK)}, t -> contains(concat_ws('\n', sup, ref, gap), t))) risk, size(filter({_list(SUPPORT)}, t -> contains(concat_ws('\n', sup, ref, gap), t))) support from args""",
        f"""with {_ARGS_DUCK}, k as (select sample_id, sup || chr(10) || ref || chr(10) || gap t from args) select sample_id, len(list_filter({_duck(RISK)}, lambda w: contains(t, w)))::int risk, len(list_filter({_duck(SUPPORT)}, lambda w: contains(t, w)))::int support from k""",
    ),
    "policy_evidence": Plan(
        "P11, P12: evidence blocks of the policy that a row names; an unknown name is an error; arguments fall back to the sources",
        f"""with {_ARGS}, p as (select sample_id, {_BLOCKS} blocks, element_at(array{_MIX}, int(pmod(sample_id, {len(_MIX)})) + 1) policy from {{samples}}),
 c as (select p.sample_id, policy, blocks, coalesce(try_element_at({_POLICY}, policy), raise_error(concat('unknown evidence policy: ', policy))) chosen, filter(array(sup, ref, gap), x -> x <> '') arguments from p join args on p.sample_id = args.sample_id)
 select sample_id, policy, case when chosen = 'args' and size(arguments) > 0 then 'args' else 'sources' end kind, array_join(case when chosen = 'args' and size(arguments) > 0 then arguments else transform(filter(blocks, b -> chosen = 'args' or array_contains(split(chosen, ','), b.src)), b -> b.txt) end, '\n') evidence from c""",
        f"""with {_ARGS_DUCK}, {_BLOCKS_DUCK}, p as (select sample_id, {_duck(_MIX)}[(sample_id % {len(_MIX)} + 1)::int] policy from samples),
 g as (select p.sample_id, policy, sup || ref || gap <> '' has_args, concat_ws(chr(10), nullif(sup, ''), nullif(ref, ''), nullif(gap, '')) args_text from p join args using (sample_id)),
 s as (select g.sample_id, string_agg(txt, chr(10) order by o, i) filter (txt <> '' and (policy in ('sources_only', 'args_only') or policy = src || '_only')) t from g join pieces using (sample_id) group by 1)
 select g.sample_id, policy, case when policy = 'args_only' and has_args then 'args' else 'sources' end kind, coalesce(case when policy = 'args_only' and has_args then args_text else s.t end, '') evidence from g left join s using (sample_id)""",
    ),
    "dataset_items": Plan(
        "M10, M9: training items: claim and evidence tokens (characters) under a policy chosen by hash, padded to the longest of their batch of thirty-two, with masks and side values",
        f"""with d as (select sample_id, pair_id, attribute_id, coalesce(y, 0) y, coalesce(c, 0.05) c, coalesce(contrastive_mask, true) contrastive, case when coalesce(trim(confidence), '') <> '' then trim(confidence) when c < 0.2 then 'absent' when c < 0.4 then 'low' when c < 0.7 then 'medium' else 'high' end confidence,
 coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0) source_count, concat(attribute_name, array_join(transform(filter(coalesce(claim.segments, array()), s -> s.text <> ''), s -> s.text), '')) claim_flow, {_BLOCKS} blocks, element_at(array('sources_only', 'params_only', 'ocr_only', 'vlm_only'), int(conv(substr(md5(cast(sample_id as string)), 1, 4), 16, 10) % 4) + 1) policy, sample_id div 32 batch from {{samples}}),
 e as (select *, concat(split_part(attribute_id, '_', 2), array_join(transform(filter(blocks, b -> policy = 'sources_only' or policy = concat(b.src, '_only')), b -> b.txt), '')) evidence_flow, aggregate(blocks, 0, (s, b) -> s + length(b.txt)) source_len from d),
 t as (select *, least(length(claim_flow), 384) claim_len, least(length(evidence_flow), 384) evidence_len from e)
 select sample_id, pair_id, attribute_id, y, c, contrastive, confidence, source_count, source_len, policy, claim_len, evidence_len, rpad(substr(claim_flow, 1, 384), max(claim_len) over (partition by batch), '□') claim_ids, max(claim_len) over (partition by batch) - claim_len claim_pad, max(evidence_len) over (partition by batch) - evidence_len evidence_pad from t""",
        f"""with {_BLOCKS_DUCK}, b as (select sample_id, ['sources_only', 'params_only', 'ocr_only', 'vlm_only'][(('0x' || substr(md5(sample_id::varchar), 1, 4))::int % 4) + 1] policy from samples),
 g as (select b.sample_id, string_agg(txt, '' order by o, i) filter (txt <> '' and (policy = 'sources_only' or policy = src || '_only')) t, coalesce(sum(length(txt)), 0)::int n from b left join pieces using (sample_id) group by 1),
 c as (select sample_id, string_agg(claim.segments[i].text, '' order by i) filter (claim.segments[i].text <> '') t from samples, unnest(range(1, len(claim.segments) + 1)) t(i) group by 1),
 f as (select s.*, b.policy, attribute_name || coalesce(c.t, '') cf, split_part(attribute_id, '_', 2) || coalesce(g.t, '') ef, g.n from samples s join b using (sample_id) join g using (sample_id) left join c using (sample_id)),
 l as (select *, least(length(cf), 384) cl, least(length(ef), 384) el from f), m as (select *, max(cl) over (partition by sample_id // 32) cm, max(el) over (partition by sample_id // 32) em from l)
 select sample_id, pair_id, attribute_id, coalesce(y, 0) y, coalesce(c, 0.05) c, coalesce(contrastive_mask, true) contrastive, coalesce(nullif(trim(confidence, ' '), ''), case when c < 0.2 then 'absent' when c < 0.4 then 'low' when c < 0.7 then 'medium' else 'high' end) confidence, coalesce(evidence_count.params, 0) + coalesce(evidence_count.ocr, 0) + coalesce(evidence_count.vlm, 0) source_count, n source_len, policy, cl claim_len, el evidence_len, substr(cf, 1, 384) || repeat('□', (cm - cl)::int) claim_ids, cm - cl claim_pad, em - el evidence_pad from m""",
    ),
    "stateful_rows": Plan(
        "P19: one wide row per sample: labels, audit, payload and provenance",
        """with facts as (select pair_id, product_id, category, coalesce(room_id, 'UNKNOWN') room_id, row_number() over (partition by pair_id order by built_ts desc, c desc nulls last, room_id desc nulls last, product_id) rn from {join_split})
 select s.sample_id, s.pair_id, s.y y_given, case when size(filter(s.reviews, r -> r.relation = 'refute')) > 0 then 1 when size(filter(s.reviews, r -> r.relation in ('support', 'mixed'))) > 0 then 0 end y_perception, s.c, s.confidence,
 coalesce(size(s.reviews), 0) n_reviews, size(filter(s.reviews, r -> r.relation in ('support', 'refute'))) n_aligned, size(filter(s.reviews, r -> r.relation in ('support', 'refute') and r.polarity = 'neg')) n_aligned_neg,
 array_join(s.evidence_params.raw_text, '|') params, array_join(s.evidence_ocr.raw_text, '|') ocr, array_join(s.evidence_vlm.raw_quote, '|') vlm, f.product_id, f.category, f.room_id, s.split, s.loaded_ts
 from {samples} s left join facts f on s.pair_id = f.pair_id and f.rn = 1""",
        """with facts as (select pair_id, product_id, category, coalesce(room_id, 'UNKNOWN') room_id, row_number() over (partition by pair_id order by built_ts desc, c desc nulls last, room_id desc nulls last, product_id) rn from join_split),
 r as (select sample_id, unnest(reviews, recursive := true) from samples), a as (select sample_id, count(*) n, count(*) filter (relation = 'refute') refute, count(*) filter (relation in ('support', 'mixed')) support, count(*) filter (relation in ('support', 'refute')) aligned, count(*) filter (relation in ('support', 'refute') and polarity = 'neg') neg from r group by 1)
 select s.sample_id, s.pair_id, s.y y_given, case when a.refute > 0 then 1 when a.support > 0 then 0 end y_perception, s.c, s.confidence, coalesce(a.n, 0)::int n_reviews, coalesce(a.aligned, 0)::int n_aligned, coalesce(a.neg, 0)::int n_aligned_neg,
 coalesce(array_to_string(list_transform(s.evidence_params, lambda x: x.raw_text), '|'), '') params, coalesce(array_to_string(list_transform(s.evidence_ocr, lambda x: x.raw_text), '|'), '') ocr, coalesce(array_to_string(list_transform(s.evidence_vlm, lambda x: x.raw_quote), '|'), '') vlm, f.product_id, f.category, f.room_id, s.split, s.loaded_ts
 from samples s left join a using (sample_id) left join facts f on s.pair_id = f.pair_id and f.rn = 1""",
    ),
    "y_from_relations": Plan(
        "X26: 1 with a refuting review, else 0 with a supporting or mixed one, else NULL; NULL too where there is no claim",
        """select sample_id, case when coalesce(claim.passage, '') = '' then null when exists(reviews, r -> r.relation = 'refute') then 1 when exists(reviews, r -> r.relation in ('support', 'mixed')) then 0 end y_perception from {samples}""",
        """with r as (select sample_id, unnest(reviews, recursive := true) from samples), k as (select sample_id, count(*) filter (relation = 'refute') a, count(*) filter (relation in ('support', 'mixed')) b from r group by 1)
 select s.sample_id, case when coalesce(claim.passage, '') = '' then null when a > 0 then 1 when b > 0 then 0 end y_perception from samples s left join k using (sample_id)""",
    ),
    "ocr_attribution": Plan(
        "X36: the OCR text that holds a quote: the named one (the quote's own place) if it does, else the first that does; quotes found nowhere are dropped",
        """with q as (select sample_id, evidence_ocr.raw_text texts, posexplode(transform(evidence_params, p -> trim(p.raw_text))) (k, quote) from {samples} where size(evidence_ocr) > 0),
 v as (select sample_id, evidence_ocr.raw_text texts, posexplode(transform(evidence_vlm, p -> trim(regexp_replace(p.raw_quote, '^图[0-9]+', '')))) (k, quote) from {samples} where size(evidence_ocr) > 0),
 o as (select sample_id, evidence_ocr.raw_text texts, posexplode(transform(evidence_ocr, p -> trim(substr(p.raw_text, 1, 6)))) (k, quote) from {samples} where size(evidence_ocr) > 0),
 a as (select 'param' kind, * from q union all select 'vlm', * from v union all select 'ocr', sample_id, texts, size(texts) - 1 - k, quote from o),
 h as (select kind, sample_id, k, quote, case when contains(get(texts, k), quote) then k else get(filter(transform(texts, (t, i) -> if(contains(t, quote), i, null)), i -> i is not null), 0) end image from a where quote <> '')
 select kind, sample_id, k, quote, image from h where image is not null""",
        """with q as (select 'param' kind, sample_id, i - 1 k, trim(evidence_params[i].raw_text, ' ') quote from samples, unnest(range(1, len(evidence_params) + 1)) t(i)
 union all select 'vlm', sample_id, i - 1, trim(regexp_replace(evidence_vlm[i].raw_quote, '^图[0-9]+', ''), ' ') from samples, unnest(range(1, len(evidence_vlm) + 1)) t(i)
 union all select 'ocr', sample_id, len(evidence_ocr) - i, trim(substr(evidence_ocr[i].raw_text, 1, 6), ' ') from samples, unnest(range(1, len(evidence_ocr) + 1)) t(i)),
 o as (select sample_id, i - 1 image, evidence_ocr[i].raw_text txt from samples, unnest(range(1, len(evidence_ocr) + 1)) t(i)),
 m as (select kind, q.sample_id, k, quote, image, row_number() over (partition by kind, q.sample_id, k order by (image = k) desc, image) rn from q join o on q.sample_id = o.sample_id and contains(txt, quote) where quote <> '')
 select kind, sample_id, k::int k, quote, image::int image from m where rn = 1""",
    ),
    "index_or_first": Plan(
        "X37: the text at the 1-based index that a quote names; the first one where the index is missing, no number or out of range",
        """with q as (select sample_id, evidence_ocr.raw_text texts, posexplode(evidence_vlm.raw_quote) (k, quote) from {samples} where size(evidence_ocr) > 0)
 select sample_id, k, quote, coalesce(get(texts, try_cast(nullif(regexp_extract(quote, '^图([0-9]+)', 1), '') as int) - 1), texts[0]) picked from q""",
        """with q as (select sample_id, i - 1 k, evidence_vlm[i].raw_quote quote, evidence_ocr from samples, unnest(range(1, len(evidence_vlm) + 1)) t(i) where len(evidence_ocr) > 0), n as (select *, try_cast(nullif(regexp_extract(quote, '^图([0-9]+)', 1), '') as int) idx from q)
 select sample_id, k::int k, quote, case when idx between 1 and len(evidence_ocr) then coalesce(evidence_ocr[idx].raw_text, evidence_ocr[1].raw_text) else evidence_ocr[1].raw_text end picked from n""",
    ),
    "policy_mix": Plan(
        "X34: names of a list with commas and blanks, here the sources and confidence that each sample states",
        """with l as (select sample_id, concat(case when evidence_count.params > 0 then 'params, ' else ' ' end, case when evidence_count.ocr > 0 then 'ocr ' else ',' end, case when evidence_count.vlm > 0 then ' vlm,,' else '' end, coalesce(confidence, '')) names from {samples})
 select policy, count(*) n from l lateral view explode(filter(split(names, '[, ]+'), x -> x <> '')) t as policy group by policy""",
        """with l as (select case when evidence_count.params > 0 then 'params, ' else ' ' end || case when evidence_count.ocr > 0 then 'ocr ' else ',' end || case when evidence_count.vlm > 0 then ' vlm,,' else '' end || coalesce(confidence, '') names from samples), p as (select unnest(string_split_regex(names, '[, ]+')) as policy from l) select policy, count(*) n from p where policy <> '' group by 1""",
    ),
    "loss_values": Plan(
        "M3: asymmetric, focal and weighted cross-entropy values of each labelled row's score as a logit, weighted by c",
        """with b as (select least(sum(1 - y) / sum(y), 50.0) w from {samples} where y is not null and c is not null), r as (select sample_id, double(y) y, greatest(c, 0.05) cw, ln(greatest(least(c, 0.999), 0.001) / (1 - greatest(least(c, 0.999), 0.001))) logit from {samples} where y is not null and c is not null),
 p as (select *, 1 / (1 + exp(-logit)) p from r), q as (select *, greatest(p - 0.05, 0) pm from p)
 select sample_id, round(-(y * ln(greatest(p, 1e-8)) + (1 - y) * ln(greatest(1 - pm, 1e-8)) * pow(pm, 4)) * cw, 6) + 0.0 asl, round(-(0.5 * y * ln(greatest(p, 1e-8)) * pow(1 - p, 2) + 0.5 * (1 - y) * ln(greatest(1 - p, 1e-8)) * pow(p, 2)) * cw, 6) + 0.0 focal, round((w * y * ln(1 + exp(-logit)) + (1 - y) * (logit + ln(1 + exp(-logit)))) * cw, 6) + 0.0 bce from q cross join b""",
        """with b as (select least(sum(1 - y) / sum(y), 50.0)::double w from samples where y is not null and c is not null), r as (select sample_id, y::double y, greatest(c, 0.05) cw, least(greatest(c, 0.001), 0.999) p0 from samples where y is not null and c is not null), p as (select *, ln(p0) - ln(1 - p0) z, p0 p, case when p0 > 0.05 then p0 - 0.05 else 0 end pm from r)
 select sample_id, round(cw * case when y = 1 then -ln(p) else -ln(1 - pm) * pm ** 4 end, 6) + 0.0 asl, round(cw * case when y = 1 then -0.5 * ln(p) * (1 - p) ** 2 else -0.5 * ln(1 - p) * p ** 2 end, 6) + 0.0 focal, round(cw * case when y = 1 then -w * ln(p) else -ln(1 - p) end, 6) + 0.0 bce from p, b""",
    ),
    "json_props": Plan(
        "X19, X40: numbers from the JSON texts of all events, malformed ones NULL",
        "select event_id, try_cast(get_json_object(props, '$.k') as int) k from {events}",
        "select event_id, try_cast(case when json_valid(props) then json_extract_string(props, '$.k') end as int) k from events",
    ),
}
