"""Rules documents that replace each other while the rules run: checks, a schedule of versions, and a fold under it.

A document counts from an instant of event time. Each event, deadline and window is judged under the document that is
valid when its store's watermark gets there, so a batch run, a stream and a stream that was restarted agree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions.ids import incident_id
from aislewise.functions.settings import duration_ms, version

from .fold import COLUMNS, OUT, Fold, State, fold_keys
from .rules import KEY, Rule, Rules

#: What the fold's columns get beside them: the document's say on the rule at that moment.
VERSIONED = [*COLUMNS, "version", "mode", "severity"]
VERSIONED_OUT = f"{OUT}, version string, mode string, severity string"
MODES = ("enforce", "shadow", "off")
ALWAYS = -(2**63)

#: Rule ids of a document, and the field of Rules that each parameter sets.
PARAMETERS = {
    "R-QUEUE-001": {"threshold": "threshold", "sustain": "sustain", "hysteresis": "hysteresis", "clearSustain": "clear_sustain"},
    "R-DWELL-001": {"zones": "dwell_zones", "limit": "limit", "sessionTtl": "ttl", "stitch": "stitch"},
    "R-ABS-001": {"trigger": None, "expect": "expect", "within": "within"},
    "R-FOOT-001": {"zones": "footfall_zones", "window": "window", "history": "history", "factor": "factor", "minCount": "min_count", "countAppeared": "count_appeared"},
}
_RULE = {"R-QUEUE-001": "queue", "R-DWELL-001": "dwell", "R-ABS-001": "absence", "R-FOOT-001": "footfall"}
_DURATIONS = {"sustain", "clear_sustain", "limit", "ttl", "stitch", "within", "window"}
_COUNTS = {"threshold", "hysteresis", "min_count"}
OPTIONAL = ("R-FOOT-001",)


# ---- documents ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Document:
    """One whole, valid document: parameters, each rule's version and definition, and the digest of its text."""

    rules: Rules
    versions: dict[str, str]
    definitions: dict[str, dict]
    digest: str


def parse(text: str) -> Document:
    """A document of JSON (or YAML, where a reader is installed); ValueError says what is wrong with it."""
    tree = _tree(text)
    if not isinstance(tree, dict) or not isinstance(tree.get("rules"), list) or not all(isinstance(r, dict) for r in tree["rules"]):
        raise ValueError("a rules document is a mapping with a list of rules")
    given = {r.get("id"): r for r in tree["rules"]}
    if len(given) < len(tree["rules"]):
        raise ValueError("a rule is there twice")
    if unknown := given.keys() - PARAMETERS.keys():
        raise ValueError(f"unknown rules {', '.join(map(str, sorted(unknown, key=str)))}")
    if missing := PARAMETERS.keys() - given.keys() - set(OPTIONAL):
        raise ValueError(f"missing rules {', '.join(sorted(missing))}")
    fields = {"grace": duration_ms(str(tree.get("grace", "")))}
    for rule, own in given.items():
        version(str(own.get("version", "")))
        if own.get("mode") not in MODES:
            raise ValueError(f"{rule}: mode is one of {', '.join(MODES)}")
        fields[_RULE[rule]] = Rule(rule, own["version"], own["mode"], own.get("severity", "medium"))
        fields |= dict(_parameters(rule, own.get("params") or {}))
    for rule in OPTIONAL:
        if rule not in given:
            fields[_RULE[rule]] = replace(getattr(Rules(), _RULE[rule]), mode="off")
    rules = replace(Rules(), **fields)
    if not 0 <= rules.hysteresis < rules.threshold:
        raise ValueError("hysteresis lies between 0 and the threshold")
    definitions = {rule: {"mode": own["mode"], "severity": own.get("severity", "medium"), "params": own.get("params")} for rule, own in given.items()}
    return Document(rules, {rule: own["version"] for rule, own in given.items()}, definitions, hashlib.sha256(text.encode()).hexdigest())


def _tree(text: str):
    try:
        return json.loads(text)
    except ValueError as e:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"not JSON: {e}") from e
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as odd:
            raise ValueError(f"neither JSON nor YAML: {odd}") from odd


def _parameters(rule: str, given: dict) -> Iterator[tuple[str, object]]:
    if unknown := given.keys() - PARAMETERS[rule].keys():
        raise ValueError(f"{rule}: unknown parameters {', '.join(sorted(unknown))}")
    for name, value in given.items():
        to = PARAMETERS[rule][name]
        if to in _DURATIONS:
            yield to, duration_ms(str(value))
        elif to in _COUNTS:
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{rule}: {name} is a count")
            yield to, value
        elif to in ("dwell_zones", "footfall_zones"):
            if not isinstance(value, list) or not all(isinstance(z, str) for z in value):
                raise ValueError(f"{rule}: {name} is a list of zones")
            yield to, tuple(value)
        elif to == "history":  # a span in the document, a number of windows here
            span, window = duration_ms(str(value)), duration_ms(str(given.get("window", "PT5M")))
            if not window or span % window:
                raise ValueError(f"{rule}: history is a whole number of windows")
            yield to, span // window
        elif to == "factor":
            yield to, float(value)
        elif to:
            yield to, value


def structural(file: Document, proposed: Document) -> list[str]:
    """What only a restart with a new file can change: the state that streams hold is laid out by it."""
    a, b, out = file.rules, proposed.rules, []
    if a.grace != b.grace:
        out.append(f"grace changes from {a.grace} ms to {b.grace} ms")
    for rule in OPTIONAL:
        if (rule in file.versions) != (rule in proposed.versions):
            out.append(f"{rule}: added or removed")
        elif (a.window, a.history, a.footfall_zones, a.count_appeared) != (b.window, b.history, b.footfall_zones, b.count_appeared):
            out.append(f"{rule}: window, history, zones or what counts as an entry changes")
    return out


def changed_without_version(running: Document, proposed: Document) -> list[str]:
    """Rules whose mode, severity or parameters differ under a version that is not higher."""
    out = []
    for rule, own in proposed.definitions.items():
        before = running.definitions.get(rule)
        if before is not None and before != own and version(proposed.versions[rule]) <= version(running.versions[rule]):
            out.append(f"{rule}: changed, but {proposed.versions[rule]} is not higher than {running.versions[rule]}")
    return out


class Schedule:
    """The deployment's file and all accepted documents, each with the instant from which on it is valid."""

    def __init__(self, file: str, kept: str | None = None):
        self.file = parse(file)
        self.texts: list[list] = [[ALWAYS, None], *(json.loads(kept) if kept else [])]
        self.documents = [self.file if text is None else parse(text) for _, text in self.texts]

    def to_json(self) -> str:
        return json.dumps(self.texts[1:])

    def publish(self, text: str | None, valid_ms: int | None = None) -> tuple[str, list[str]]:
        """("APPLIED" | "SAME" | "REFUSED" | "RESET", reasons). None as text goes back to the file.

        A refused document changes nothing. A document is never valid before the one it replaces: valid_ms is put off
        to that one's, and None means at once.
        """
        running = self.documents[-1]
        if text is None:
            kind, own = "RESET", self.file
        else:
            try:
                own = parse(text)
            except ValueError as e:
                return "REFUSED", [str(e)]
            if own.digest == running.digest:
                return "SAME", []
            if reasons := structural(self.file, own) + changed_without_version(running, own):
                return "REFUSED", reasons
            kind = "APPLIED"
        self.texts.append([max(self.texts[-1][0], ALWAYS if valid_ms is None else valid_ms), text])
        self.documents.append(own)
        return kind, []

    def valid_from(self, i: int) -> int:
        return self.texts[i][0]

    def __len__(self) -> int:
        return len(self.texts)


# ---- a store's fold under the schedule ----------------------------------------------------------------------------


class VersionedFold:
    """A Fold whose rules change as its watermark passes the instants of the schedule.

    Up to an instant everything is met under the old document, then deadlines are set anew from the same state. A
    document that comes when the watermark is past its instant counts from the watermark on.
    """

    def __init__(self, schedule: Schedule, state: State | None = None, at: int = 0):
        self.schedule, self.at = schedule, at
        self.fold = Fold(schedule.documents[at].rules, state)

    @property
    def s(self) -> State:
        return self.fold.s

    def feed(self, e: dict) -> list[tuple]:
        return [*self._switched(max(self.s.top, e["t_ms"]) - self.fold.r.grace), *self._named(self.fold.feed(e))]

    def flush_to(self, watermark: int) -> list[tuple]:
        return [*self._switched(watermark), *self._named(self.fold.flush_to(watermark))]

    def _switched(self, watermark: int) -> list[tuple]:
        out: list[tuple] = []
        while self.at + 1 < len(self.schedule) and self.schedule.valid_from(self.at + 1) <= watermark:
            self.at += 1
            if self.schedule.valid_from(self.at) > ALWAYS:
                out += self._named(self.fold.flush_to(self.schedule.valid_from(self.at) - 1))
            self.fold = Fold(self.schedule.documents[self.at].rules, self.fold.s)
        return out

    def _named(self, incidents: list[tuple]) -> list[tuple]:
        r = self.fold.r
        say = {rule.id: (rule.version, rule.mode, rule.severity) for rule in (r.queue, r.dwell, r.absence)}
        return [(*i, *say[i[0]]) for i in incidents]


def fold_incidents_scheduled(events: DataFrame, file: str, published: list[tuple[int | None, str | None]], flush_ms: int | None = None) -> DataFrame:
    """fold_incidents() of events under a file and documents (valid_ms, text or None) published over it, in a batch."""
    Schedule(file)  # a file that does not parse is an error here, not in tasks

    def make() -> VersionedFold:
        schedule = Schedule(file)
        for valid_ms, text in published:
            schedule.publish(text, valid_ms)
        return VersionedFold(schedule)

    return fold_keys(events, make, VERSIONED, VERSIONED_OUT, flush_ms)


def with_incident_ids(incidents: DataFrame) -> DataFrame:
    """The fold's rows with incident_id: the same from one minor version to the next, another for a new major one."""
    by_rule = [F.when((F.col("rule") == rule), _id(rule)) for rule in PARAMETERS]
    return incidents.withColumn("incident_id", F.coalesce(*by_rule))


def _id(rule: str) -> Column:
    return incident_id(rule, F.col("version"), F.col("store_id"), F.col("run_id"), F.col("key"), F.col("onset_ms"))


# ---- footfall under the schedule ----------------------------------------------------------------------------------


def footfall_spikes_scheduled(windows: DataFrame, schedule: Schedule) -> DataFrame:
    """Spike incidents of footfall_windows(), each window under the document valid at the window's end.

    Window, history and zones are the same in all documents; factor, least count, version, mode and severity are the
    columns of the few documents, chosen by the window's end. A rule that is off gives no rows and opens no spike.
    """
    end = F.col("start_ms") + schedule.file.rules.window
    own = F.lit(None)
    for i, d in enumerate(schedule.documents):
        r = d.rules
        say = F.struct(F.lit(r.factor).alias("factor"), F.lit(r.min_count).alias("least"), F.lit(r.footfall.version).alias("version"), F.lit(r.footfall.mode).alias("mode"), F.lit(r.footfall.severity).alias("severity"))
        own = say if i == 0 else F.when(end >= schedule.valid_from(i), say).otherwise(own)
    r = schedule.file.rules
    w = W.partitionBy(*KEY, "zone_id").orderBy("start_ms")
    past = w.rowsBetween(-r.history, -1)
    h = windows.withColumns({"_d": own, "_n": F.count("n").over(past), "_sum": F.coalesce(F.sum("n").over(past), F.lit(0))})
    spike = (F.col("_n") == r.history) & (F.col("n") >= F.col("_d.least")) & ((F.col("n") * r.history).cast("double") > F.col("_d.factor") * F.col("_sum")) & (F.col("_d.mode") != "off")
    h = h.withColumn("spike", spike).withColumn("_was", F.coalesce(F.lag("spike").over(w), F.lit(False)))
    h = h.withColumn("onset_ms", F.last(F.when(F.col("spike") & ~F.col("_was"), F.col("start_ms")), True).over(w)).where("spike <> _was and _d.mode <> 'off'")
    return h.select(
        F.lit("R-FOOT-001").alias("rule"), F.when(F.col("spike"), "OPENED").otherwise("RESOLVED").alias("kind"), *KEY, F.col("zone_id").alias("key"),
        F.col("onset_ms"), (F.col("start_ms") + r.window).alias("detected_ms"), *[F.col(f"_d.{c}").alias(c) for c in ("version", "mode", "severity")],
    )
