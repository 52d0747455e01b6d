"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from hourline.llm import bpe
from hourline.llm.common import table
from hourline.llm.licenses import op1_license_scans
from hourline.llm.neighbours import op5_neighbours
from hourline.llm.classlm import op11_class_lm
from hourline.llm.merkle import OP12_SQL, op12_merkle
from hourline.llm.resample import OP13_SQL, op13_resample
from hourline.llm.warc import OP7_SQL, op7_warc
from hourline.llm.language import op6_language_id
from hourline.llm.quality import OP4_SQL, op4_quality_rules
from hourline.llm.suffix import op2_suffix_dedup
from hourline.llm.urls import op9_url_filters
from hourline.llm.simhash import op3_simhash
from hourline.llm.mixing import OP8_SQL, op8_mixing


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_neighbours": op5_neighbours,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_class_lm": op11_class_lm,
    "op12_merkle": op12_merkle,
    "op13_resample": op13_resample,
}
SQL = {"op4_quality_rules": OP4_SQL, "op7_warc": OP7_SQL, "op8_mixing": OP8_SQL, "op12_merkle": OP12_SQL, "op13_resample": OP13_SQL}
