"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query is run once to warm up and
then timed; results go to the noop sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowsentry.plans import catalog
from flowsentry.session import local_session

HEADLINE = [
    "a1_overview_stats",
    "a2_packets_per_minute",
    "a3_protocol_distribution",
    "a4_top_talkers",
    "a5_geo_traffic",
    "a6_threat_timeline",
    "a10_mitre_techniques",
    "a13_protocol_stats",
    "a15_connections",
    "t2_recent_events",
    "p3_search_events",
    "j5_geo_enrich",
    "j6_threshold_rules",
    "f6_payload_entropy",
    "w1_recent_count",
    "w6_ip_sessions",
    "d1_port_scan",
    "d2_syn_flood",
    "d3_lateral_movement",
    "d4_udp_flood",
    "d5_http_flood",
    "d6_c2_beacon",
    "d7_dns_recon",
    "d8_icmp_large",
    "d9_icmp_flood",
    "d10_ssh_brute_force",
    "d11_smtp_large",
    "d12_ntp_amplification",
    "d13_exfil",
    "d14_all_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    packets = catalog.view(spark, sf_dir, "packets").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    total = round(sum(seconds.values()), 3)
    rates = {name: round(packets / value) for name, value in seconds.items() if name[0] == "d" and value}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "packets": packets,
                "packets_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
