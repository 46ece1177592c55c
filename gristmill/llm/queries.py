"""Queries of this package, by name; sql.py has the SQL of those that SQL can express."""

from gristmill.llm.bpe import p8_ids
from gristmill.llm.capping import p3_capped, p3_found
from gristmill.llm.leakage import p6_found, p6_matches
from gristmill.llm.overlap import p1_found, p1_report
from gristmill.llm.packing import p9_packed
from gristmill.llm.pairs import p2_found
from gristmill.llm.quota import p7_found, p7_quotas, p7_sample
from gristmill.llm.splits import p5_found, p5_splits
from gristmill.llm.splitting import p4_found, p4_pieces
from gristmill.llm.truncation import p10_found, p10_limits, p10_rates

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_capped, p4_found, p4_pieces, p5_found, p5_splits, p6_found, p6_matches, p7_found, p7_quotas, p7_sample, p8_ids, p9_packed, p10_found, p10_limits, p10_rates)}
