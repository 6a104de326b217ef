"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, fingerprints, jaccard, langid, licenses, lm, packing, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_licenses": licenses.op2_licenses,
        "op3_lm": lm.op3_lm,
        "op4_bpe": bpe.op4_bpe,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_langid": langid.op6_langid,
        "op7_packing": packing.op7_packing,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_chat": chat.op9_chat,
        "op10_fingerprints": fingerprints.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": embeddings.SQL, "op2_licenses": licenses.SQL, "op8_jaccard": jaccard.SQL, "op9_chat": chat.SQL}
