"""python -m tidemark.inspect header|list|verify|dump PATH [SNAPSHOT ADDRESS]: read-only; exit 0, 1 (fault found) or 2 (usage)."""

from __future__ import annotations

import json
import sys


def main(args: list[str], spark=None) -> int:
    if len(args) < 2 or args[0] not in ("header", "list", "verify", "dump") or args[0] == "dump" and len(args) != 4:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from .errors import StoreError
    from .sources.store import Store

    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if args[0] == "header":
            print(json.dumps(Store.peek(spark, args[1])))
            return 0
        with Store.open(spark, args[1], read_only=True) as store:
            if args[0] == "list":
                for s in store.list_snapshots():
                    print(s.id, s.type, s.parent, sum(b["items"] for d in s.data.values() for b in d["blocks"]), sep="\t")
            elif args[0] == "verify":
                print(json.dumps(store.verify(full=True)))
            else:
                for row in store.scan(int(args[2]), args[3], ordered=True).toLocalIterator():
                    print(row[0], *row[1:], sep="\t")
    except StoreError as e:
        print(f"{type(e).__name__}: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
