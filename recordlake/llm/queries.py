"""One query per operator over its whole table, in the form its contract states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_labeller, decontaminate, grammar_files, host_rules, line_dedup, near_duplicates, packing, periodic_runs, personal_data, resampling,
    secret_automata, spelling_variants, url_rules,
)
from .common import table, work_folder
from .oracles import ORACLES  # noqa: F401

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_pack_sum_of_squares(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


@query
def op2_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = resampling.fit(docs, resampling.judgements(table(spark, sf_dir, "labels")))
    out, how = resampling.resample(docs, model, carry=["doc_id"])
    return out.select("doc_id", c(how["weight"]).alias("log_weight"), c(how["noisy"]).alias("noisy_weight"), c(how["selected"]).alias("kept"))


@query
def op3_grammar_files(spark, sf_dir):
    path = grammar_files.write(
        table(spark, sf_dir, "documents"), work_folder(spark, "grammar"), tokenizer("byte_bpe_50k.json"), end_id=2
    )
    return grammar_files.read_documents(spark, path)


URL_RULES = [
    url_rules.host_rule("org", "/", "allow"), url_rules.host_rule("example.org", "/es/", "block"),
    url_rules.host_rule("example.org", "/en/1", "block"), url_rules.host_rule("com", "/fr/", "allow"),
    url_rules.host_rule("com", "/de/", "block"),
    *(url_rules.label_rule(w) for w in ("ads", "adult", "casino", "cheap-pills", "porn", "tracker", "warez")),
]


@query
def op4_url_pattern_rules(spark, sf_dir):
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    own = ~F.coalesce(c("rule").startswith("label:"), F.lit(False))
    return judged.select("page_id", "host", "path", F.when(own, c("rule")).alias("rule"), "verdict")


@query
def op5_host_rules(spark, sf_dir):
    found = host_rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_block_labeller(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return block_labeller.extract(pages, block_labeller.fit(pages))


@query
def op7_line_bitmaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.line_report(docs, line_dedup.keep_bitmaps(docs))


@query
def op8_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.fit(docs))


@query
def op9_suffix_automaton(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query
def op10_tensored_minhash(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), n=2)


@query
def op11_secret_automata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_automata.find(docs, secret_automata.fit(docs))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(k) for k in secret_automata.BASE), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans")
    )


@query
def op12_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_loops(table(spark, sf_dir, "documents"), every=10)
    found = periodic_runs.find(docs).withColumn("top", periodic_runs.top_run(c("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * c("top.length") / c("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@query
def op13_spelling_variants(spark, sf_dir):
    found = spelling_variants.group_variants(table(spark, sf_dir, "documents"), damage=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
