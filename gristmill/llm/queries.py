"""Registered queries of the operators: op1 to op13."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import (
    bpe,
    decontaminate,
    fill_in_middle,
    language,
    licenses,
    pseudonyms,
    quality_classifier,
    quality_rules,
    quotes,
    secret_scan,
    simhash,
    spellings,
    toxicity,
)

#: The key of the pseudonyms here; a real run takes its own from its secret store.
PSEUDONYM_KEY = "registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_divergence_rules(spark, sf_dir):
    return quality_rules.check(table(spark, sf_dir, "documents"))


def op2_rule_ensemble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, learn))
    score = F.col("__score")
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op3_covering_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op4_secret_scan(spark, sf_dir):
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("__secrets.base")
    count = lambda rank: F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text("__secrets.base"), 256).alias("base_sha256"),
        secret_scan.spans_text("__secrets.spans").alias("spans"),
    )


def op5_feistel_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_containment_search(spark, sf_dir):
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "item_id", "n_shared", "n_shingles")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP6_SQL = f"""
with words as (select doc_id, {_WORDS.format("text")} as w from documents),
item_words as (select item_id, {_WORDS.format("text")} as w from benchmark),
shingles as (
    select distinct doc_id, unnest([array_to_string(w[i:i+n-1], ' ') for i in range(1, len(w) - n + 2)]) as s
    from words, (select 5 as n union select len(w) from item_words where len(w) between 1 and 4)),
item_shingles as (
    select distinct item_id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 3, 2))]) as s
    from item_words where len(w) > 0),
sizes as (select item_id, count(*) as n_shingles from item_shingles group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_shingles) as n_shingles
from shingles join item_shingles using (s) join sizes using (item_id)
group by doc_id, item_id
having count(*) >= 0.8 * any_value(n_shingles)
"""


def op7_trie_bpe(spark, sf_dir):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])


def quoting_messages(spark, sf_dir) -> DataFrame:
    """``conversations`` as mail: every turn quotes the turn before, and below it the
    one before that. message_id numbers turns within conversations."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    quoted = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"),
        "text",
        *(F.lag(c, k).over(own).alias(f"{c}{k}") for c in ("role", "text") for k in (1, 2)),
    )
    deeper = F.concat(F.lit("> "), F.col("role2"), F.lit(" wrote:\n"), quoted(F.col("text2"), "> > "), F.lit("\n"))
    mail = F.concat(F.col("role1"), F.lit(" wrote:\n"), F.coalesce(deeper, F.lit("")), quoted(F.col("text1"), "> "), F.lit("\n\n"), F.col("text"))
    return turns.select("message_id", F.coalesce(mail, "text").alias("text"))


def op8_quote_links(spark, sf_dir):
    found = quotes.conversations(quoting_messages(spark, sf_dir), "message_id")
    return found.select("message_id", "conversation", "parent", "depth", F.sha2(quotes.normalised(F.col("body")), 256).alias("body_sha256"))


OP8_SQL = r"""
with recursive turns as (
    select conv_id * 1000000 + turn as message_id,
           trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as norm,
           lag(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) over (partition by conv_id order by turn) as before
    from conversations),
firsts as (select norm, min(message_id) as first from turns where length(norm) >= 8 group by norm),
links as (
    select message_id, turns.norm, first as parent
    from turns left join firsts on before = firsts.norm and first < message_id),
tree as (
    select message_id, norm, message_id as conversation, parent, 0::bigint as depth from links where parent is null
    union all
    select l.message_id, l.norm, t.conversation, l.parent, t.depth + 1 from links l join tree t on l.parent = t.message_id)
select message_id, conversation, parent, depth, sha256(norm) as body_sha256 from tree
"""


def op9_language_bloom(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder(3) != 1).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_string_kernel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, learn))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_license_join(spark, sf_dir):
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("__licenses")
    starts = F.transform(found["hits"], lambda h: h["start"])
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        F.size(found["hits"]).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(F.transform(found["hits"], lambda h: h["label"])).alias("base_labels"),
        named(found["labels"]).alias("labels"),
        found["score"].alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op11_sql(threshold: float = 0.9) -> str:
    """Every block with every template, and the phrases, in plain SQL."""
    made = licenses.as_templates(licenses.TEMPLATES, threshold)
    templates = ", ".join(f"({_quoted(t.label)}, [{', '.join(map(_quoted, t.words))}], {t.need})" for t in made)
    phrases = ", ".join(f"([{', '.join(map(_quoted, p.split(' ')))}], {_quoted(label)})" for p, label in licenses.PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with templates(label, tw, need) as (values {templates}),
phrases(pw, label) as (values {phrases}),
low as (
    select row_number() over () as r, doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents),
words as (select r, doc_id, regexp_extract_all(t, '{word}') as w from low),
hits as (
    select r, label, unnest([k for k in range(0, len(w)) if w[k + 1:k + len(pw)] = pw]) as start
    from words, phrases where list_contains(w, pw[1])),
lines as (select r, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from low),
line_words as (select r, i, regexp_extract_all(line, '{word}') as w from lines),
parts as (select r, i, w, sum((len(w) = 0)::int) over (partition by r order by i) as part from line_words),
blocks as (
    select r, 'l' || i as block, list_distinct(w) as w from parts where len(w) > 0
    union all
    select r, 'p' || part, list_distinct(flatten(list(w))) from parts where len(w) > 0 group by r, part),
shared as (select r, block, label, need, len(tw) as size, len(list_intersect(w, tw)) as n from blocks, templates),
met as (select *, n::double / size as fit from shared where n >= need),
best as (select * from met qualify rank() over (partition by r, block order by fit desc, n desc) = 1),
labelled as (select r, label, 1.0::double as fit from hits union all select r, label, fit from best),
named as (select r, string_agg(distinct label, ',' order by label) as labels, max(fit) as score from labelled group by r),
based as (
    select r, count(*) as n_base, min(start) as first_word, max(start) as last_word,
           string_agg(distinct label, ',' order by label) as base_labels
    from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from words left join based using (r) left join named using (r)
"""


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    output = F.col("output")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(output, F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
with cut as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
           sha256('1:' || coalesce(doc_id::varchar, '')) as d
    from documents),
drawn as (
    select *, len(u)::bigint as n,
           ('0x' || d[1:8])::ubigint % (len(u) + 1) as c1, ('0x' || d[9:16])::ubigint % (len(u) + 1) as c2,
           ('0x' || d[17:24])::ubigint % 100 as h3, ('0x' || d[25:32])::ubigint % 100 as h4
    from cut),
parts as (
    select *, array_to_string(u[1:least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
           array_to_string(u[greatest(c1, c2) + 1:], '') as s,
           case when t = '' or h3 >= 90 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
                when h4 < 20 then 'spm' else 'psm' end as form
    from drawn)
select doc_id, n, form,
       case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""


def op13_spelling_chunks(spark, sf_dir):
    found = spellings.group_spellings(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_divergence_rules, op2_rule_ensemble, op3_covering_simhash, op4_secret_scan, op5_feistel_pseudonyms,
        op6_containment_search, op7_trie_bpe, op8_quote_links, op9_language_bloom, op10_string_kernel, op11_license_join,
        op12_fill_in_middle, op13_spelling_chunks,
    )
}
SQL = {
    "op6_containment_search": OP6_SQL,
    "op8_quote_links": OP8_SQL,
    "op11_license_join": _op11_sql(),
    "op12_fill_in_middle": OP12_SQL,
}
