import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowsentry.session import local_session

    checkpoints = tmp_path_factory.mktemp("checkpoints")
    session = local_session("8", 4, **{"spark.checkpoint.dir": str(checkpoints)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def packets_of(spark):
    """Packets from dicts; what a test leaves out gets a default."""
    from pyspark.sql import functions as F

    from flowsentry.schemas import PACKETS

    def build(rows, **extra):
        base = {
            "src_ip": "10.0.0.1",
            "dst_ip": "10.0.0.2",
            "src_port": 5000,
            "dst_port": 80,
            "protocol": "TCP",
            "length": 100,
            "flags": "",
            "payload_hex": None,
            "is_malicious": 0,
        }
        names = [field.name for field in PACKETS.fields]
        data = []
        for number, row in enumerate(rows):
            full = {**base, **extra, "pid": number, "ts_us": number * 1_000_000, **row}
            data.append(tuple(full.get(name) for name in names))
        df = spark.createDataFrame(data, PACKETS)
        return df.withColumn("payload", F.unhex("payload_hex"))

    return build
