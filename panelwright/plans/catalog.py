"""Every registered query of the analytics operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans.registry import QUERIES, SQL

MODULES = ("q_metrics", "q_align", "q_matrix", "q_nav", "q_screen", "q_walk", "q_tune", "q_files", "q_more")
for _m in MODULES:
    import_module(f"panelwright.plans.{_m}")


#: Earlier names of queries that once ran over part of the symbols or months; they are the same queries now.
FORMER = {
    "enumerate_all_combos": "enumerate_combos",
    "evaluate_all_combos": "evaluate_combos",
    "all_combo_scores": "combo_scores",
    "best_of_all_combos": "best_combo",
    "all_combos_metric_filter": "combo_metric_filter",
    "all_combos_sort_page": "combo_sort_page",
    "materialize_best_combos": "combo_materialize",
} | {f"{x}_all_months": x for x in "inner_folds slice_panel trailing_momentum relative_momentum_rank momentum_top_k dual_momentum oos_chain pick_combo_winner tuning_training_start".split()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["score_rank"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {old: QUERIES[now] for old, now in FORMER.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {old: SQL[now] for old, now in FORMER.items()}
