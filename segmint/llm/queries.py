"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.llm._util import bounded, id_crc_mod, table
from segmint.llm.bpe import encode_documents
from segmint.llm.curves import nearest
from segmint.llm.exact_dedup import exact_dedup
from segmint.llm.langid import identify
from segmint.llm.lattice_lm import score_documents
from segmint.llm.licenses import license_digest, license_sql, scan_licenses
from segmint.llm.mixing import mix
from segmint.llm.runs import periodic_runs, planted, runs_digest
from segmint.llm.simhash import hex_fingerprint, near_duplicates
from segmint.llm.substring import remove_repeats
from segmint.llm.token_counts import count_tokens
from segmint.llm.toxicity import fit as fit_toxicity
from segmint.llm.toxicity import score as score_toxicity
from segmint.llm.whitening import whiten

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: The target mix: domains of the sources, weights by path in the tree (1 where none is stated), the budget's share of all tokens.
DOMAINS = {"web": ("src0",), "books": tuple(f"src{i}" for i in range(1, 7)), "news": tuple(f"src{i}" for i in range(7, 14))}
MIX_LANGS = {"en": 4, "de": 2, "fr": 2, "es": 2}
MIX_WEIGHTS = {("web",): 3, ("books",): 3, ("news",): 2, ("other",): 2} | {(d, n): w for d in (*DOMAINS, "other") for n, w in MIX_LANGS.items()}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (4, 5), 2, 17


def tree() -> dict[str, Column]:
    """The levels: domain (of the source), language, source."""
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit SimHash and the smallest doc_id that it is linked to, through others or not."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, seed=42, d=4)
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 13-word windows that an earlier one has."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its group of equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = id_crc_mod("doc_id", 5) == 0
    model = fit_toxicity(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram base score and its probability under the lattice model, learnt from nine tenths."""
    return score_documents(table(spark, sf_dir, "documents"), id_crc_mod("doc_id", 10) == 0, PIECES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the three quarters that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = id_crc_mod("doc_id", 4) == 2
    found = identify(docs, docs.where(~held & F.col("lang").isNotNull()))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the target mix takes, a row for each time."""
    return mix(table(spark, sf_dir, "documents"), tree(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's tokens and of what they decode to."""
    coded = encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses a line's end counts where it starts."""
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, rule="first")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places of licence phrases and the labels of the notices that it holds."""
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, with the repetitions that the ids' checksums plant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return runs_digest(periodic_runs(docs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's whitened value along the eight components of most variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: bounded(f) for f in (
    op1_simhash, op2_substring, op3_exact_dedup, op4_toxicity, op5_nearest, op6_lattice_lm, op7_language_id, op8_mixing, op9_byte_bpe, op10_token_counts,
    op11_licenses, op12_runs, op13_whitening)}


def _mixing_sql() -> str:
    """The same tree, level by level: shares by weight, full children first, the rest by weight, rounded down."""
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(map(repr, s))}) THEN '{d}'" for d, s in DOMAINS.items()) + " ELSE 'other' END"
    by_domain = "CASE domain " + " ".join(f"WHEN '{k[0]}' THEN {w}" for k, w in MIX_WEIGHTS.items() if len(k) == 1) + " ELSE 1 END"
    by_lang = "CASE lang " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in MIX_LANGS.items()) + " ELSE 1 END"

    def level(name: str, path: list[str], weight: str, above: str) -> str:
        parent, cols = ", ".join(path[:-1]) or "0", ", ".join(path)
        given = f"JOIN {above} USING ({parent})" if above else f"CROSS JOIN (SELECT (sum(available) * {MIX_SHARE[0]}) // {MIX_SHARE[1]} AS given FROM leaves)"
        by = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {path[-1]}"
        return f"""
             {name}0 AS (SELECT {cols}, (sum(available) * {MIX_EPOCHS})::HUGEINT AS cap, {weight} AS w FROM leaves GROUP BY {cols} HAVING sum(available) > 0),
             {name}1 AS (SELECT *, given::HUGEINT - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                                sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}0 {given}),
             {name}2 AS (SELECT *, max(CASE WHEN cap * ws > remaining * w THEN 1 ELSE 0 END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM {name}1),
             {name} AS (SELECT {cols}, CASE WHEN open = 0 THEN cap ELSE
                          ((given::HUGEINT - coalesce(sum(cap) FILTER (open = 0) OVER (PARTITION BY {parent}), 0)) * w)
                          // (sum(w) FILTER (open = 1) OVER (PARTITION BY {parent})) END AS given FROM {name}2)"""

    return f"""
        WITH rows AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
             leaves AS (SELECT domain, lang, source, sum(n_tokens) AS available FROM rows GROUP BY ALL),{level("a", ["domain"], by_domain, "")},{level("b", ["domain", "lang"], by_lang, "a")},{level("c", ["domain", "lang", "source"], "1", "b")},
             placed AS (SELECT rows.*, (given // available)::INT AS full_epochs, given % available AS rest
                        FROM rows JOIN leaves USING (domain, lang, source) JOIN c USING (domain, lang, source)),
             ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}|' || (full_epochs + 1) || '|' || doc_id), doc_id, n_tokens
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM placed)
        SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(1, full_epochs + 1 + (running <= rest)::INT))::INT AS epoch FROM ranked"""


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             g AS (SELECT norm, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op8_mixing": _mixing_sql(),
    "op11_licenses": license_sql(),
}
