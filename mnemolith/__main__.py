"""python -m mnemolith validate|migrate|scan FOLDER [--strict] [--write OUT] [--tree OUT] [--in-place [--backup]] [--commit SHA]

validate exits 1 on errors (and on warnings if strict), 2 on misuse. migrate lists what changes; --write gives
its table as Parquet, --tree all pages as Markdown files in another folder, --in-place rewrites the changed pages where they are,
with --backup keeping each as .bak. If a page can't be migrated, no Markdown is written and it exits 1.
scan names files by their path in the folder and stamps the commit that is checked out there (HEAD if there is none, or --commit) and
the name of the remote, else the folder's.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import codefacts, lint, migrate, surface
from .sources.files import checkout, read_markdown, read_sources, write_facts, write_markdown
from .sources.tables import materialize


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("validate", "migrate", "scan"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("mnemolith").getOrCreate()
    out = args[args.index("--write") + 1] if "--write" in args else None
    if args[0] == "validate":
        issues = materialize(lint.validate_bundle(read_markdown(spark, args[1]), "--strict" in args)).orderBy("path", "severity", "message")
        for r in issues.toLocalIterator():
            print(f"{r['severity']}: {r['path']}: {r['message']}")
        return lint.issue_counts(issues, "--strict" in args).first()["exit_code"]
    if args[0] == "migrate":
        done = materialize(migrate.migrate_bundle(read_markdown(spark, args[1]))).orderBy("path")
        for r in done.where("changed OR error IS NOT NULL").toLocalIterator():
            print(f"{r['path']}: {r['error'] or 'changed'}")
        if out:
            done.write.parquet(out)
        tree = args[args.index("--tree") + 1] if "--tree" in args else None
        if tree or "--in-place" in args:
            if not done.where("error IS NOT NULL").isEmpty():
                return 1
            if tree:
                write_markdown(done, tree)
            if "--in-place" in args:
                write_markdown(done.where("changed"), args[1], "--backup" in args)
        return 0
    commit, remote = checkout(spark, args[1])
    name = spark.range(1).select(surface.repo_name(F.lit(remote), F.lit(os.path.abspath(args[1]) if "://" not in args[1] else args[1]))).first()[0]
    facts = codefacts.scan_facts(read_sources(spark, args[1]), name, args[args.index("--commit") + 1] if "--commit" in args else commit or "HEAD")
    if out:
        write_facts(facts, codefacts.snippets(facts), out)
    else:
        for r in facts.drop("content").toLocalIterator():
            print(f"{r['path']}:{r['line']}: {r['kind']} {r['symbol']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
