"""What users call: the index, the ledger and the truth files of one project, kept as versioned snapshots."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import extract as ex
from .functions.text import line_of, normalize_path, since_seconds
from .operators import audit, detect, fuzzy, guard, index, ledger, postedit
from .sources import trees
from .store import Change, Snapshots, Version
from .tables import materialize, numbered


#: The tables, their columns, and the column by which rows go when a file or an entry changes.
TABLES = {"files": (schema.FILES, "path"), "symbols": (schema.SYMBOLS, "file_path"), "decisions": (schema.DECISIONS, "id"), "claims": (schema.CLAIMS, "id")}


class Engine:
    """All tables lie under `root`, a folder that the cluster shares. Reads are lazy; writes commit a new version.

    Every write is made from one version and shown only if its tables have not changed since, else it is made again; it
    writes the rows that change, not the table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.snapshots = spark, Snapshots(spark, root, {name: key for name, (_, key) in TABLES.items()})

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """A table as a version (by default the current one) knows it: columns that an older one did not write are null."""
        version = version or self.snapshots.version()
        kind = TABLES[name][0]
        return self.snapshots.read(name, version, kind) if name in version else self.spark.createDataFrame([], kind)

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @property
    def decisions(self) -> DataFrame:
        return self.table("decisions")

    @property
    def claims(self) -> DataFrame:
        return self.table("claims")

    # index

    def index(self, root: str, ignore: list[str] | None = None) -> DataFrame:
        """Scan a tree, parse what changed, drop what is gone; both tables change in one commit. Returns the failures.

        The tree is listed once and changed files are read and parsed once, into tables. A file that does not parse has a
        row and no symbols.
        """
        scanned, failures = trees.scan_tree(self.spark, root, ignore)
        scanned = materialize(scanned.select("path", "hash", "language", "size_bytes", "indexed_at", F.decode("content", "UTF-8").alias("text")), "scanned")
        new = index.changed(scanned, self.files)
        parsed = materialize(ex.extract(new.select("path", "language", "text")), "parsed")
        bad = parsed.where("error IS NOT NULL").select("path", "error")
        fresh = postedit.symbols_of(parsed.join(bad.select("path").distinct(), "path", "left_anti"))

        def make(version: Version) -> dict[str, Change]:
            files = self.table("files", version)
            kept = index.prune(files, scanned, trees.SKIPPED).select("path")
            rows = index.changed(scanned, files).drop("text")
            gone = materialize(files.select("path").join(kept, "path", "left_anti").unionByName(rows.select("path")), "gone")
            return {"files": Change(rows, gone), "symbols": Change(fresh.join(rows.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(fresh.columns), gone.select(F.col("path").alias("file_path")))}

        self.snapshots.transact(make)
        return failures.unionByName(bad)

    def index_file(self, root: str, path: str) -> None:
        """One file of the tree, as it is now; nothing changes if it is missing, of no known kind or out of the tree."""
        found = trees.scan_file(self.spark, root, path)
        edit = found.select(F.lit(1).cast("bigint").alias("id"), F.lit("").alias("session_id"), F.lit("").alias("tool"), "path", F.decode("content", "UTF-8").alias("content"))
        at = found.agg(F.max("indexed_at")).first()[0]
        if at is not None:
            files, symbols, _ = postedit.edited(edit, "/", at)
            self.snapshots.transact(lambda version: self._replaced(files, symbols))

    @staticmethod
    def _replaced(files: DataFrame, symbols: DataFrame) -> dict[str, Change]:
        """These files' rows and symbols instead of all that their paths had."""
        return {"files": Change(files, files.select("path")), "symbols": Change(symbols, files.select(F.col("path").alias("file_path")))}

    def find_symbol(self, query: str, kind: str | None = None, limit: int = 0, language: str | None = None) -> DataFrame:
        return index.find_symbol(self.symbols, query, kind, limit, language)

    def verify_symbol(self, name: str, kind: str | None = None, language: str | None = None) -> DataFrame:
        return index.verify_symbol(self.symbols, name, kind, language)

    def verify_qualified(self, qualified: str) -> DataFrame:
        return index.verify_qualified(self.symbols, qualified)

    def get_file(self, path: str) -> DataFrame:
        return index.get_file(self.files, path)

    def all_files(self) -> DataFrame:
        return index.all_files(self.files)

    def list_files(self, pattern: str | None = None, language: str | None = None, limit: int = 0) -> DataFrame:
        return index.list_files(self.files, pattern, language, limit)

    def recent_changes(self, since: int = 0, limit: int = 0) -> DataFrame:
        return index.recent_changes(self.files, since, limit)

    def doctor(self, root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Counts by language, files that look as if their symbols were missed, and counts of the ledger's (capped) lists.

        root: the tree on disk, of which files that are gone are not suspects.
        """
        bad = index.suspects(self.files, self.symbols, trees.scan_tree(self.spark, root)[0]) if root else index.empty_files(self.files, self.symbols)
        counts = index.ledger_counts(self.decisions, ledger.unverified(self._claims()), self.get_stale_decisions())
        return index.language_counts(self.files, self.symbols), bad, counts

    # ledger

    def _append(self, name: str, rows: list[dict]) -> list[int]:
        """Add rows with the next ids."""
        fields = self.spark.createDataFrame([], TABLES[name][0]).schema
        ids: list[int] = []

        def make(version: Version) -> dict[str, Change]:
            last = self.table(name, version).agg(F.max("id")).first()[0] or 0
            ids[:] = [last + 1 + k for k in range(len(rows))]
            return {name: Change(self.spark.createDataFrame([tuple({**dict.fromkeys(fields.names), **row, "id": i}[n] for n in fields.names) for i, row in zip(ids, rows)], fields).coalesce(1))}

        self.snapshots.transact(make)
        return ids

    def _changed(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Write the rows that make(table) gives instead of those of the same id: their new form, or a new entry."""

        def change(version: Version) -> dict[str, Change]:
            rows = materialize(make(self.table(name, version)), "changed")
            return {name: Change(rows, rows.select("id"))}

        self.snapshots.transact(change)

    def _claims(self) -> DataFrame:
        """The claims with the pointers that successes give them."""
        return ledger.supersede_claims(self.claims.drop("superseded_by"))

    def record_decision(self, topic: str, choice: str, reasoning: str, now: int, **more) -> int:
        if not topic:
            raise ValueError("a decision needs a topic")
        return self._append("decisions", [{"topic": topic, "choice": choice, "reasoning": reasoning, "recorded_at": now} | more])[0]

    def supersede_decision(self, id: int, choice: str, reasoning: str, now: int) -> int:
        new: list[int] = []

        def make(rows: DataFrame) -> DataFrame:
            if not rows.where((F.col("id") == id) & F.col("superseded_by").isNull()).count():
                raise ValueError("no such decision, or it is superseded")
            new[:] = [rows.agg(F.max("id")).first()[0] + 1]
            return ledger.supersede(rows.where(F.col("id") == id), id, new[0], choice, reasoning, now).select(rows.columns)

        self._changed("decisions", make)
        return new[0]

    def get_decisions(self, topic: str | None = None, since: int = 0, limit: int = 0) -> DataFrame:
        size = F.octet_length("topic") + F.octet_length("choice") + F.octet_length(F.coalesce("reasoning", F.lit("")))
        rows = ledger.decisions(self.decisions, topic, since, schema.clamp(limit, schema.DECISION_ROWS))
        return ledger.within_bytes(rows, size, [F.desc("recorded_at"), F.desc("id")])

    def get_stale_decisions(self, limit: int = 0) -> DataFrame:
        d = self.decisions
        files, names = (d.select("id", F.posexplode(c).alias("pos", "ref")) for c in ("related_files", "related_symbols"))
        have = self.symbols.select(F.col("name").alias("ref")).union(self.symbols.select("qualified_name")).distinct()
        a = ledger.stale_decisions(d, files, self.files.select(F.col("path").alias("ref")), limit)
        return a.unionByName(ledger.stale_decisions(d, names, have, limit))

    def record_claim(self, claim: str, evidence: str, verified: bool, now: int, **more) -> int:
        """more: further columns of a claim; a path is kept with forward slashes and in NFC."""
        if more.get("file_path"):
            more["file_path"] = unicodedata.normalize("NFC", more["file_path"].replace("\\", "/"))
        return self._append("claims", [{"claim": claim, "evidence": evidence, "verified": verified, "recorded_at": now, "session_id": ""} | more])[0]

    def get_claim(self, id: int) -> DataFrame:
        found = self._claims().where(F.col("id") == id)
        if found.isEmpty():
            raise KeyError(f"no claim {id}")
        return found

    def unverified_claims(self, limit: int = 0) -> DataFrame:
        return ledger.unverified_listing(self._claims(), limit)

    def stale_claims(self, now: int, session: str | None = None) -> DataFrame:
        return ledger.stale(self._claims(), now, session)

    def touch_claims(self, ids: list[int], now: int) -> None:
        """These claims were checked now; an id that no claim has is an error, and nothing changes."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id bigint")

        def make(claims: DataFrame) -> DataFrame:
            gone = [r[0] for r in ledger.missing(claims, wanted).orderBy("id").limit(5).collect()]
            if gone:
                raise KeyError(f"no claim {gone}")
            return ledger.touch(claims.join(wanted, "id", "left_semi"), wanted, now)

        self._changed("claims", make)

    def _removed(self, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Take the claims away that kept(claims) leaves out: only their ids are written."""

        def change(version: Version) -> dict[str, Change]:
            claims = self.table("claims", version)
            return {"claims": Change(gone=claims.select("id").join(kept(claims).select("id"), "id", "left_anti"))}

        if "claims" in self.snapshots.version():
            self.snapshots.transact(change)

    def purge_claims(self, before: int) -> None:
        self._removed(lambda claims: ledger.purge(ledger.supersede_claims(claims.drop("superseded_by")), before))

    def migrate(self) -> None:
        """Drop what older versions recorded about edits that they had refused."""
        self._removed(ledger.drop_refused)

    def resolve_claim(self, id: int, note: str = "") -> None:
        def make(claims: DataFrame) -> DataFrame:
            found = claims.where(F.col("id") == id)
            if found.isEmpty():
                raise ValueError("no such claim")
            return ledger.resolve(found, id, note)

        self._changed("claims", make)

    def truth_history(self, path: str, limit: int = schema.HISTORY_ROWS) -> DataFrame:
        return ledger.truth_history(self.decisions, path, limit)

    def truth_story(self, scope: str | None = None, since: str | None = None) -> DataFrame:
        """(scope, n, n_trivial, first, last) of the truth changes, by scope; since: a day YYYY-MM-DD."""
        rows = self.decisions.where("truth_change IS NOT NULL")
        if since:
            start = self.spark.range(1).select(since_seconds(F.lit(since))).first()[0]
            if start is None:
                raise ValueError(f"{since!r} is not YYYY-MM-DD")
            rows = rows.where(F.col("recorded_at") >= start)
        if scope:
            if scope not in ("domain", "toolkit"):
                raise ValueError(f"no scope {scope!r}")
            rows = rows.where(F.col("truth_change.scope") == scope)
        return ledger.truth_story(rows)

    def session_start(self, source: str, limit: int = 10) -> DataFrame:
        return audit.session_start(self.decisions, source, limit)

    def session_stop(self, session: str) -> DataFrame:
        return ledger.session_summary(self._claims().where(F.col("session_id") == session))

    def post_edit(self, edits: DataFrame, root: str, now: int, verify: Callable[[str], tuple[bool, str, str | None]] | None = None, verb: str = "verify", noise: tuple[str, ...] = (), epoch: tuple[str, int] | None = None) -> DataFrame:
        """Index a batch of edits, verify the project once, record a claim for each edit; returns the claims.

        edits: id (their order), session_id, tool, path, content. verify: root to (passed, output, exit error); without
        one nothing runs. Files, symbols and claims change in one commit; a success clears earlier failures when read.
        epoch: a stream and its batch's number, committed along; store.Replayed is raised if it was before.
        """
        rows, fresh, events = postedit.edited(materialize(edits, "edits"), root, now)
        rows, fresh = materialize(rows, "files"), materialize(fresh, "symbols")
        passed, output, error = verify(root) if verify else (None, "", None)
        told = postedit.claims_of(events, verb, verify is not None, passed, output, error, now, noise)
        told = numbered(told.withColumn("file_path", normalize_path("file_path")), ["id"], "__n")
        claims: list[DataFrame] = []

        def make(version: Version) -> dict[str, Change]:
            last = self.table("claims", version).agg(F.max("id")).first()[0] or 0
            new = told.withColumn("id", F.lit(last).cast("bigint") + F.col("__n"))
            claims[:] = [new.select([c.split()[0] for c in schema.CLAIMS.split(", ")])]
            return self._replaced(rows, fresh) | {"claims": Change(claims[0])}

        self.snapshots.transact(make, epoch)
        return claims[0]

    # facts and stories

    def list_facts(self, facts: DataFrame, category: str = "") -> DataFrame:
        return detect.visible_facts(detect.at_path(facts, category) if category else facts)

    def stats(self, facts: DataFrame, rules: DataFrame | None = None, stories: dict | None = None) -> DataFrame:
        return detect.truth_stats(facts, rules, len(stories or {}))

    def lint(self, facts: DataFrame, today: str, days: int = 180) -> DataFrame:
        return detect.stale_facts(facts, today, days)

    def get_story(self, stories: dict[str, dict], name: str) -> dict:
        return trees.get_story(stories, name)

    def sync(self, facts: DataFrame, fetch: Callable[[str, str], str], pattern: str) -> tuple[DataFrame, DataFrame]:
        return audit.sync(facts, fetch, pattern)

    # prose

    def facts_impact(self, docs: DataFrame, facts: DataFrame, path: str, key: str = "id") -> DataFrame:
        """Where the facts under a path occur: by path, documents with a strong hit first, then by key."""
        return detect.facts_impact(docs, detect.at_path(facts, path), key).orderBy("path", F.col("strong_hits") == 0, key)

    def corpus_summary(self, docs: DataFrame, facts: DataFrame, rules: DataFrame | None = None, key: str = "id") -> DataFrame:
        return detect.corpus_summary(docs, detect.summary(self.check(docs, facts, rules, key), key), key)

    def verify_claim(self, text: str, facts: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(claims, counts) of one text; the counts leave contradictions out, as the tool's answer does."""
        if len(text.encode()) >= schema.CLAIM_TEXT_BYTES:
            raise ValueError(f"the text exceeds {schema.CLAIM_TEXT_BYTES} bytes")
        found = self.check(self.spark.createDataFrame([(1, text)], "id bigint, text string"), facts, rules)
        return found, detect.summary(found).drop("id", "contradiction")

    def list_stale_claims(self, root: str, facts: DataFrame, rules: DataFrame | None = None, scope: str | None = None) -> tuple[DataFrame, int]:
        """(claims that need a look, exit code) of every markdown file of a tree, whole: unverified, forbidden and contradicted ones with file and line.

        scope: a glob of files of any kind instead, ignored or not.
        """
        docs = trees.markdown_files(self.spark, root, scope).withColumnRenamed("path", "id")
        found = materialize(self.check(docs, facts, rules), "claims")
        code = detect.severity(detect.summary(found)).first()[0]
        return found.where(F.col("verdict").isin("unverified", "forbidden", "contradiction")).select(F.col("id").alias("file"), "line", "category", "verdict", "text", "path"), code

    def pre_edit(self, events: DataFrame, facts: DataFrame, rules: DataFrame, root: str, path_filters=(), content_filters=(), **more) -> DataFrame:
        """(id, decision, reason) of proposed edits: events (id, tool, path, text, command), rules (ord, text, fuzz, reason); more: guard.guard_edits()'s."""
        scan = events.select("id", guard.scanned_text(F.col("tool"), F.col("text"), F.col("command")).alias("text")).where("text IS NOT NULL")
        found = detect.detect(scan, facts, fuzzy.forbidden(scan, rules), detect.contradictions(scan, facts))
        return guard.guard_edits(events, found, rules, list(path_filters), list(content_filters), root, **more)

    def check(self, docs: DataFrame, facts: DataFrame, rules: DataFrame | None = None, key: str = "id", most_bytes: int | None = None) -> DataFrame:
        """Claims of documents (key, text) with their lines. A rule's column fuzz is the number of edits it forgives (1 without it).

        most_bytes: longer documents are not scanned, as a tool that answers at once has it.
        """
        if most_bytes is not None:
            docs = docs.where(F.octet_length("text") <= most_bytes)
        forbidden = fuzzy.forbidden(docs, rules, key) if rules is not None else None
        found = detect.detect(docs, facts, forbidden, detect.contradictions(docs, facts, key), key)
        return found.join(docs.select(key, "text").withColumnRenamed("text", "__t"), key).withColumn("line", line_of(F.col("__t"), F.col("start"))).drop("__t")
