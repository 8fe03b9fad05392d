"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm.licenses import op6_licenses
from thicket.llm.lines import OP4_SQL, op4_lines
from thicket.llm.media import op3_media
from thicket.llm.mixing import OP1_SQL, op1_mixing
from thicket.llm.packing import op5_packing
from thicket.llm.quality import op10_quality
from thicket.llm.repeats import OP9_SQL, op9_repeats
from thicket.llm.simhash import op2_simhash
from thicket.llm.toxicity import op7_toxicity
from thicket.llm.warc import OP8_SQL, op8_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_simhash": op2_simhash,
        "op3_media": op3_media,
        "op4_lines": op4_lines,
        "op5_packing": op5_packing,
        "op6_licenses": op6_licenses,
        "op7_toxicity": op7_toxicity,
        "op8_warc": op8_warc,
        "op9_repeats": op9_repeats,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op4_lines": OP4_SQL,
        "op8_warc": OP8_SQL,
        "op9_repeats": OP9_SQL,
    }
