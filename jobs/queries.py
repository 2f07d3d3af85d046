"""The jobs as queries: run twice into a new folder, and the output as it stands then."""

from __future__ import annotations

from jobs import network_static, term_assembly

QUERIES = {"job1_term_assembly": term_assembly.job1_term_assembly, "job2_network_static": network_static.job2_network_static}
SQL = {"job1_term_assembly": term_assembly.SQL, "job2_network_static": network_static.SQL}
