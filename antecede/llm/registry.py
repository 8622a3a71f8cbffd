"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chosen_path import op9_chosen_path
from .common import ship
from .language_id import op7_naive_bayes
from .line_rules import OP8_SQL, op8_line_rules
from .mixing import op2_entropy_balancing
from .nn_descent import op4_nn_descent
from .packing import op3_packing
from .sharding import op6_virtual_slots
from .sstable import op1_sstable
from .suffix_dedup import op10_prefix_doubling
from .url_filter import OP5_SQL, op5_url_vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Query] = {
    "op1_sstable": op1_sstable,
    "op2_entropy_balancing": op2_entropy_balancing,
    "op3_packing": op3_packing,
    "op4_nn_descent": op4_nn_descent,
    "op5_url_vocabulary": op5_url_vocabulary,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_naive_bayes": op7_naive_bayes,
    "op8_line_rules": op8_line_rules,
    "op9_chosen_path": op9_chosen_path,
    "op10_prefix_doubling": op10_prefix_doubling,
}
QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _ALL.items()}
ORACLE_SQL: dict[str, str] = {"op5_url_vocabulary": OP5_SQL, "op8_line_rules": OP8_SQL}
