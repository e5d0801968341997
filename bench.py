"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "rel_01_post_comment_join",
    "rel_05_nest_comments",
    "txt_02_correct_spelling",
    "txt_05_clean_text",
    "txt_08_urls_symbols_to_blank",
    "txt_12_remove_stop_words",
    "tok_01_lexer",
    "tok_02_tokenize",
    "lm_03_bigram_counts",
    "lm_06_conditional_probability",
    "top_03_term_counts",
    "top_05_document_terms",
    "top_06_choose_topics",
    "sen_02_inverse_document_frequency",
    "sen_07_report",
    "sen_12_sentence_scores",
    "grf_08_components",
    "grf_11_shortest_tree",
    "cor_11_rebuild_sentences",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from chatterloom.plans import catalog
    from chatterloom.session import build_session

    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
