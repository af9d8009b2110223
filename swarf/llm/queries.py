"""The registered queries of this folder; each reads its whole table."""

from __future__ import annotations

from swarf.llm import alignment, decontaminate, jaccard_join, lattice, lexical, mixing, neighbours, packing, repeats, sharding, token_files, toxicity, url_filter
from swarf.llm.common import table

QUERIES = {
    "op1_mix": lambda spark, sf_dir: mixing.op1_mix(table(spark, sf_dir, "documents")),
    "op2_token_files": lambda spark, sf_dir: token_files.op2_token_files(spark, table(spark, sf_dir, "documents")),
    "op3_repeats": lambda spark, sf_dir: repeats.op3_repeats(table(spark, sf_dir, "documents")),
    "op4_url_filter": lambda spark, sf_dir: url_filter.op4_url_filter(table(spark, sf_dir, "pages")),
    "op5_jaccard_join": lambda spark, sf_dir: jaccard_join.op5_jaccard_join(table(spark, sf_dir, "documents")),
    "op6_decontaminate": lambda spark, sf_dir: decontaminate.op6_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_toxicity": lambda spark, sf_dir: toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_shard": lambda spark, sf_dir: sharding.op8_shard(table(spark, sf_dir, "documents")),
    "op9_neighbours": lambda spark, sf_dir: neighbours.op9_neighbours(table(spark, sf_dir, "embeddings")),
    "op10_lm_score": lambda spark, sf_dir: lattice.op10_lm_score(table(spark, sf_dir, "documents")),
    "op11_search": lambda spark, sf_dir: lexical.op11_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_pack": lambda spark, sf_dir: packing.op12_pack(table(spark, sf_dir, "documents")),
    "op13_align": lambda spark, sf_dir: alignment.op13_align(table(spark, sf_dir, "documents")),
}
SQL: dict[str, str] = {"op11_search": lexical.OP11_SQL}
