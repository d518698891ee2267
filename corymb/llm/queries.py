"""The queries of this subpackage and their SQL; ``__spark_entry__.py`` adds them if it can import this."""

from __future__ import annotations

from corymb.llm import blocks, bytecnn, countjoin, gam, hilbert, idfiles, line_dedup, merkle, mixing, orderhash, ownership, periodic, winnow


def _docs(f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _docs_and(table, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict:
    return {
        "op1_winnowing": _docs_and("benchmark", winnow.decontamination_digest),
        "op2_order_minhash": _docs(orderhash.edit_digest),
        "op3_hilbert_shards": _docs(hilbert.shard_digest),
        "op4_ownership_secrets": _docs(ownership.scan_digest),
        "op5_block_lstm": lambda spark, sf_dir: blocks.page_digest(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op6_byte_cnn": _docs(bytecnn.language_digest),
        "op7_site_lines": _docs(line_dedup.line_digest),
        "op8_additive_quality": _docs_and("labels", gam.quality_digest),
        "op9_water_filling": _docs(mixing.mix_digest),
        "op10_count_join": _docs(countjoin.join_digest),
        "op11_merkle_manifest": _docs(merkle.proof_digest),
        "op12_token_files": _docs(idfiles.id_digest),
        "op13_periodic_runs": _docs(periodic.run_digest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_winnowing": winnow.DECONTAMINATION_SQL,
        "op3_hilbert_shards": hilbert.shard_sql(),
        "op4_ownership_secrets": ownership.SCAN_SQL,
        "op7_site_lines": line_dedup.LINE_SQL,
        "op9_water_filling": mixing.MIX_SQL,
        "op10_count_join": countjoin.JOIN_SQL,
        "op11_merkle_manifest": merkle.PROOF_SQL,
    }
