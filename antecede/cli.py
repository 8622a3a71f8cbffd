"""``python -m antecede.cli --log DIR [--append JSON --kind KIND] [--call DIR | --listen DIR] [--state PROJECTION]``: a log
as a node. In that order: an event is appended, the node syncs with one other over a shared folder, the state is printed.
What comes by a sync is appended to the log."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .exchange import Connection, answer, call, run
from .functions.identity import frame, genesis
from .kernel import Node
from .operators.project import projections
from .operators.replicate import diff
from .plans.steps import Step
from .sources.wal import FileStore


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--log", required=True)
    parser.add_argument("--append", metavar="JSON")
    parser.add_argument("--kind", default="set")
    parser.add_argument("--name", default="node")
    parser.add_argument("--call", metavar="DIR", help="begin a sync over this shared folder")
    parser.add_argument("--listen", metavar="DIR", help="answer one sync over this shared folder")
    parser.add_argument("--wait", type=float, default=60.0, help="seconds to wait for the other side")
    parser.add_argument("--state", choices=projections())
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("antecede").getOrCreate()
    store, kernel = FileStore(spark, args.log), Node(spark, args.name)
    kernel.append(store.load_all())
    if args.append is not None:
        new = frame(spark, [kernel.new_event(args.kind, json.loads(args.append))])
        if store.is_empty():
            store.append(frame(spark, [genesis()]))
        store.append(new)
        kernel.append(new)
    for path, own, other, side in ((args.call, "caller", "listener", call), (args.listen, "listener", "caller", answer)):
        if path is not None:
            link = Connection(spark, path, own, other)
            print(run(side(kernel, link), link, args.wait))
            store.append(Step(diff(kernel.events, store.known_ids()), "came").df)
    tips = kernel.frontier().orderBy("id")
    print(f"{kernel.history_size()} events, frontier {[r['id'] for r in tips.toLocalIterator()]}")
    if args.state:
        state = kernel.state(args.state)
        for row in state.orderBy(*state.columns).toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
