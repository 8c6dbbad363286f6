"""Registered queries of the operators, and SQL where it can express them.

Each takes (spark, sf_dir) and applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import language_id, media, packing, quality_classifier, quality_rules, secret_scan, sentence_pieces, sharding, simhash_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(spark, media.store(spark, table(spark, sf_dir, "documents")))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(spark, table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(spark, table(spark, sf_dir, "documents")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(spark, table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(spark, table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_media, op3_sentence_pieces, op4_quality_rules, op5_secret_scan, op6_simhash_dedup, op7_packing, op8_sharding, op9_quality_classifier, op10_language_id)}


def _any_case(pattern: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def secret_scan_sql() -> str:
    """Matches and the gaps between them, in order, give every match's place."""
    assign = _any_case("password|passwd|secret|token|api_?key")
    patterns = {"assign": rf"""({assign})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""}
    patterns |= {r.kind: r.pattern for r in secret_scan.RULES[1:]}
    quoted = {k: "'" + p.replace("\\'", "'").replace("'", "''") + "'" for k, p in patterns.items()}
    kinds = " union all ".join(f"select doc_id, {n} r, '{k}' kind, regexp_extract_all(t, {q}) m, string_split_regex(t, {q}) g from d" for n, (k, q) in enumerate(quoted.items()))
    least = " ".join(f"when {n} then {r.least}" for n, r in enumerate(secret_scan.RULES) if n)
    said = "string_agg(kind || ':' || a || ':' || (a + length(x)), ',' order by a, r)"
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), k as ({kinds}),
i as (select *, unnest(range(1, len(m) + 1)) i from k where len(m) > 0),
s as (select doc_id, r, kind, m[i] x, cast(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as bigint) a from i),
f as (select * from s where case when r = 0 then length(regexp_extract(x, {quoted["assign"]}, 2)) >= 6 else length(x) >= case r {least} end end),
o as (select doc_id, count(*) filter (r = 0) n_assign, count(*) filter (r = 1) n_access, count(*) filter (r = 2) n_hex, {said.replace("order by a, r)", "order by a, r) filter (r < 3)")} base, {said} spans from f group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join o on d.doc_id = o.doc_id"""


def quality_rules_sql() -> str:
    """Common words of each language, histograms in long form, medians, means of what is near them, and distances."""
    rules = quality_rules.Rules()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    sets = {"vowel": "aeiou", "consonant": "bcdfghjklmnpqrstvwxyz", "upper": "A-Z", "digit": "0-9", "space": r"\x20\t", "newline": r"\n\v\f\r", "stop": ".,;:!?", "quote": "'\"()\\-", "symbol": "#*$%&|<>", "two": r"\x{80}-\x{7FF}", "three": r"\x{800}-\x{FFFF}", "four": r"\x{10000}-\x{10FFFF}"}
    counted = " union all ".join(f"select doc_id, {k!r} k, length(regexp_replace(t, {text('[^' + x + ']')}, '', 'g')) c from d" for k, x in sets.items())
    apart = lambda p, q: f"sqrt(greatest(0, least(1, sum(case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end + case when {q} > 0 then {q} * log2({q} / (({p} + {q}) / 2)) else 0 end) / 2)))"
    limit = f"greatest({rules.least_word_limit}, least(0.999, {rules.word_noise} / sqrt(greatest(n_words, 1))))"
    return f"""with d as (select doc_id, coalesce(text, '') t, lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from d),
win as (select doc_id, i, w, lead(w) over o w2, lead(w, 2) over o w3 from w window o as (partition by doc_id order by i)),
twice as (select doc_id, unnest(range(i, i + 3)) i from (select *, count(*) over (partition by doc_id, w, w2, w3) n from win where w3 is not null) where n > 1),
rep as (select doc_id, count(distinct i) n from twice group by 1),
ln as (select doc_id, unnest(string_split(t, chr(10))) l from d),
dup as (select doc_id, count(*) - count(distinct l) n from ln where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
base as (select d.doc_id, lang, cast(len(ws) as bigint) n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, len(ws) < {rules.least_words} or 100 * coalesce(rep.n, 0) > {rules.most_repeated_percent} * len(ws) base_failed from d left join dup on dup.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id),
some_ as ({counted}), cls as (select * from some_ union all select d.doc_id, 'other', length(t) - (select sum(c) from some_ where some_.doc_id = d.doc_id) from d),
sh as (select doc_id, k, c / greatest(sum(c) over (partition by doc_id), 1) p from cls),
plain as (select doc_id, lower(trim(w, {text(quality_rules.EDGES)})) word, count(*) n from w group by 1, 2),
langs as (select lang, count(*) n from documents where lang is not null group by 1 having count(*) >= {rules.least_documents}),
drawn as (select doc_id, lang from documents join langs using (lang) where cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 < {2.0 * rules.learn_from} / n),
cw as (select lang, word from (select lang, word, row_number() over (partition by lang order by count(*) desc, word) k from drawn join plain using (doc_id) where word <> '' group by 1, 2) where k <= {rules.common_words}),
of_ as (select doc_id, lang, word, n from plain join cw using (word)),
tot as (select doc_id, lang, sum(n) n from of_ group by 1, 2),
ws as (select d.doc_id, cw.lang, cw.word, coalesce(of_.n, 0) / greatest(coalesce(tot.n, 0), 1) p, coalesce(tot.n, 0) n from d cross join cw
  left join of_ on of_.doc_id = d.doc_id and of_.lang = cw.lang and of_.word = cw.word left join tot on tot.doc_id = d.doc_id and tot.lang = cw.lang),
pass as (select base.* from base join langs using (lang) where not base_failed),
md as (select lang, k, quantile_disc(p, 0.5) m from pass join sh using (doc_id) group by 1, 2),
mid as (select lang, k, m / sum(m) over (partition by lang) q from md),
near as (select doc_id, min(x) x from (select doc_id, lang, {apart("p", "q")} x from sh join mid using (k) group by 1, 2) group by 1),
good as (select pass.* from pass join near using (doc_id) where not (n_words >= {rules.min_words} and x > {rules.max_class_distance})),
rc as (select lang, k, avg(p) q from good join sh using (doc_id) group by 1, 2),
rw as (select ws.lang, word, coalesce(avg(p) filter (n >= {rules.min_common}), 0) q from good join ws on ws.doc_id = good.doc_id and ws.lang = good.lang group by 1, 2),
bc as (select doc_id, lang, {apart("p", "q")} x from sh join rc using (k) group by 1, 2),
bw as (select doc_id, ws.lang, case when sum(q) <= 0 then 0 when max(n) = 0 then 1 else {apart("p", "q")} end x from ws join rw on rw.lang = ws.lang and rw.word = ws.word group by 1, 2),
best as (select doc_id, arg_min({{'lang': lang, 'c': bc.x, 'w': coalesce(bw.x, 0)}}, (bc.x + coalesce(bw.x, 0), lang)) b from bc left join bw using (doc_id, lang) group by 1)
select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ((lang is null or lang in (select lang from rc)) and n_words >= {rules.min_words} and (coalesce(b.c, 0) > {rules.max_class_distance} or coalesce(b.w, 0) > {limit})) kept,
  b.lang closest, round(coalesce(b.c, 0), 6) class_distance, round(coalesce(b.w, 0), 6) word_distance from base left join best on best.doc_id = base.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules_sql(), "op5_secret_scan": secret_scan_sql()}
