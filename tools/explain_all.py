"""Write the formatted physical plan of every registered query to a folder.

usage: python tools/explain_all.py <sf_dir> <out_dir>
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statline.plans.registry import queries  # noqa: E402
from statline.session import get_session  # noqa: E402


def main() -> None:
    sf_dir, out = sys.argv[1], sys.argv[2]
    os.makedirs(out, exist_ok=True)
    spark = get_session("local[8]", 16)
    for name, q in sorted(queries().items()):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            q(spark, sf_dir).explain("formatted")
        with open(os.path.join(out, f"{name}.txt"), "w") as f:
            f.write(buf.getvalue())
        text = buf.getvalue()

        def n(op: str) -> int:
            return len(re.findall(rf"^\(\d+\) {op}\b", text, flags=re.M))
        print(f"{name}: {n('Exchange')} shuffles, {n('BroadcastExchange')} broadcasts, "
              f"{n('Scan parquet')} scans")
    spark.stop()


if __name__ == "__main__":
    main()
