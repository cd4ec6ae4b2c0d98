"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewatch.llm import prefix_trie, rule_ledger, source_divergence, source_mixing
from tidewatch.llm.decontaminate import op10_benchmark_windows
from tidewatch.llm.html_main_text import op9_html_main_text
from tidewatch.llm.katz import op2_katz_scores
from tidewatch.llm.prefix_trie import op12_prefix_trie
from tidewatch.llm.quality_gbt import op4_quality_gbt
from tidewatch.llm.rule_ledger import op5_rule_ledger, rule_ablations
from tidewatch.llm.secret_scan import op7_secret_markov_scan
from tidewatch.llm.simhash_dedup import op6_simhash_pivot_dedup
from tidewatch.llm.source_divergence import op13_source_divergence
from tidewatch.llm.source_mixing import op1_mix_sources
from tidewatch.llm.token_counts import op8_token_counts
from tidewatch.llm.warc_derivatives import op3_warc_derivatives
from tidewatch.llm.wavelet_ids import op11_wavelet_ids

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_katz_scores": op2_katz_scores,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_quality_gbt": op4_quality_gbt,
    "op5_rule_ledger": op5_rule_ledger,
    "op6_simhash_pivot_dedup": op6_simhash_pivot_dedup,
    "op7_secret_markov_scan": op7_secret_markov_scan,
    "op8_token_counts": op8_token_counts,
    "op9_html_main_text": op9_html_main_text,
    "op10_benchmark_windows": op10_benchmark_windows,
    "op11_wavelet_ids": op11_wavelet_ids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
    "rule_ablations": rule_ablations,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": source_mixing.ORACLE,
    "op5_rule_ledger": rule_ledger.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
    "rule_ablations": rule_ledger.ABLATIONS_ORACLE,
}
