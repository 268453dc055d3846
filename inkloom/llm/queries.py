"""Queries of the training-data operators; their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from .abuse import p9_found, p9_rates
from .bpe import p7_ids
from .confusables import p4_found, p4_groups, p4_scripts, p4_text
from .leaks import p8_found
from .markup import p2_articles, p2_clean, p2_found
from .near_dup import p1_found
from .sentences import p3_found, p3_lengths
from .site_lines import p5_clean, p5_found
from .split_overlap import p6_found, p6_report

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_clean": p2_clean, "p2_articles": p2_articles, "p3_found": p3_found, "p3_lengths": p3_lengths, "p4_found": p4_found, "p4_groups": p4_groups, "p4_text": p4_text, "p4_scripts": p4_scripts, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_report": p6_report, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_rates": p9_rates}
ORACLE: dict[str, str] = {}
