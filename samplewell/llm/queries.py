"""The queries opN_<name>: each operator over its whole table, with production parameters, as its contract states."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewell.llm import bpe_codec, decontaminate, fingerprints, html_text, jaccard_join, language_id, secrets, token_counts, toxicity, url_rules
from samplewell.llm.oracles import ORACLES  # noqa: F401
from samplewell.llm.shared import read


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.edit_fingerprints(read(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    net = language_id.train(docs, F.coalesce(_remainder(4) != 2, F.lit(False)))
    return language_id.identify(docs, net, held_out)


def op4_html_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_url_rules(spark, sf_dir):
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op7_bpe_codec(spark, sf_dir):
    return bpe_codec.digests(read(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels, F.coalesce(_remainder(3) != 1, F.lit(False)))
    return toxicity.toxicity(docs, lexicon, F.coalesce(_remainder(3) == 1, F.lit(False)))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_rules": op6_url_rules,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
}
