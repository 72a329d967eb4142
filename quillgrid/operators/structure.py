"""Documents by kind: which archetype a page is, which sections it lacks, and which site generators a tree holds."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled, escaped
from quillgrid.functions.segment import BLANKS, Document


def plain(heading: str) -> str:
    """A heading as sections are compared: lower case, links unwrapped, without markers and numbering."""
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", heading.lower())
    s = re.sub(r"^[0-9]+[.)]\s*", "", re.sub("[`*_#:]", "", s))
    return re.sub(f"[{BLANKS}]+", " ", s).strip()


@dataclass(frozen=True)
class Section:
    """A section by name, other names of it, whether a page must have it, and whether a field at the top may stand for it."""

    name: str
    others: tuple[str, ...]
    required: bool
    field: bool = False

    @property
    def aliases(self) -> tuple[str, ...]:
        return tuple(map(plain, (self.name, *self.others)))


@dataclass(frozen=True)
class Kind:
    type: str
    label: str
    folders: tuple[str, ...]
    files: tuple[str, ...]
    exact: tuple[str, ...]
    markers: tuple[str, ...]
    strong: tuple[str, ...]
    sections: tuple[Section, ...]
    statuses: tuple[str, ...] = ()
    blame: tuple[str, ...] = ()


# The archetypes, by path, headings and sections.
KINDS = (
    Kind(
        "adr", "ADR (Architecture Decision Record)",
        (r"(^|\/)(adr|adrs|decisions)(\/|$)", r"(^|\/)docs\/(adr|decisions)(\/|$)"),
        (r"(^|[-_/])adr[-_]", r"\badr\b", r"^\d{1,4}[-_].+\.(md|mdx)$", r"^\d{8}[-_].+\.(md|mdx)$"), (),
        ("decision", "consequences", "context", "considered options", "decision outcome", "status"),
        ("consequences", "considered options", "decision outcome"),
        (
            Section("Status", (), True, field=True),
            Section("Context", ("context and problem statement",), True),
            Section("Decision", ("decision outcome",), True),
            Section("Consequences", (), True),
            Section("Considered Options", ("options", "alternatives"), False),
        ),
        ("proposed", "accepted", "rejected", "deprecated", "superseded"),
    ),
    Kind(
        "postmortem", "Postmortem / incident retrospective",
        (r"(^|\/)(postmortems?|post-mortems?|incidents?|retros?)(\/|$)",), (r"post[-_]?mortem", r"\bretro(spective)?\b", r"(^|[-_/])incident[-_]"), (),
        ("timeline", "root cause", "root causes", "contributing factors", "impact", "action items", "corrective actions", "lessons learned", "detection", "resolution"),
        ("root cause", "root causes", "contributing factors", "action items", "corrective actions", "lessons learned"),
        (
            Section("Summary", ("overview", "what happened"), True),
            Section("Impact", (), True),
            Section("Timeline", (), True),
            Section("Root Cause", ("root causes", "contributing factors", "fault"), True),
            Section("Action Items", ("corrective actions", "follow-up", "follow-ups"), True),
            Section("Lessons Learned", ("what went well", "how'd we do"), True),
            Section("Detection", (), False),
            Section("Resolution", ("recovery",), False),
        ),
        blame=(r"\bblame[ds]?\b", r"\bat fault\b", r"\b(his|her|their) (fault|mistake|error)\b", r"\bshould have known\b", r"\bincompeten", r"\bcareless\b", r"\bnegligen"),
    ),
    Kind(
        "runbook", "Runbook / operational guide",
        (r"(^|\/)(runbooks?|playbooks?|ops|operations)(\/|$)",), (r"run[-_]?book", r"play[-_]?book"), (),
        ("prerequisites", "steps", "procedure", "rollback", "escalation", "trigger", "triggers", "when to use", "validation", "verification"),
        ("rollback", "escalation"),
        (
            Section("Overview", ("purpose", "summary", "objective", "description"), True),
            Section("Prerequisites", ("preconditions", "requirements", "before you begin"), True),
            Section("Steps", ("procedure", "instructions", "resolution", "mitigation"), True),
            Section("Rollback", ("recovery", "remediation", "cleanup"), True),
            Section("Escalation", ("contacts", "contact", "on-call", "who to contact"), True),
            Section("Triggers", ("trigger", "when to use"), False),
            Section("Validation", ("verification",), False),
        ),
    ),
    Kind(
        "rfc", "RFC / design doc",
        (r"(^|\/)(rfcs?|rfds?|designs?|proposals?|plans?)(\/|$)", r"(^|\/)docs\/(design|rfcs?|proposals?|plans?)(\/|$)"),
        (r"(^|[-_/])rfc[-_]", r"(^|[-_/])rfd[-_]", r"[-_]design\.(md|mdx)$", r"(^|[-_/])design[-_]", r"proposal", r"[-_]plan\.(md|mdx)$"), (),
        ("motivation", "goals", "non-goals", "alternatives", "drawbacks", "rationale and alternatives", "guide-level explanation", "reference-level explanation", "unresolved questions", "open questions", "prior art", "summary", "problem", "problem statement", "problem frame", "background", "requirements", "out of scope", "in scope", "proposed", "design", "verification"),
        ("non-goals", "drawbacks", "alternatives", "rationale and alternatives", "unresolved questions", "out of scope", "prior art", "guide-level explanation", "reference-level explanation", "problem frame"),
        (
            Section("Summary", ("abstract", "overview", "tldr"), True),
            Section("Motivation", ("goals", "problem", "problem statement", "problem frame", "background", "requirements", "why"), True),
            Section("Alternatives", ("rationale and alternatives", "alternatives considered", "other approaches"), True),
            Section("Drawbacks", ("risks", "tradeoffs", "trade-offs", "downsides"), True),
            Section("Non-goals", ("non goals", "out of scope", "scope boundaries"), False),
            Section("Unresolved Questions", ("open questions", "open product decisions"), False),
        ),
    ),
    Kind(
        "contributing", "Contributing guide", (r"(^|\/)\.github(\/|$)", r"(^|\/)docs\/contributing(\/|$)"), (), (r"^contributing(\.[a-z-]+)?\.(md|mdx|rst|txt)$",),
        ("how to contribute", "ways to contribute", "getting started", "development", "development setup", "local development", "building", "pull request", "pull requests", "pull request process", "submitting changes", "submitting a pull request", "reporting bugs", "reporting issues", "issues", "code of conduct", "style guide", "coding style", "coding conventions", "testing", "running tests", "commit messages"),
        ("pull request process", "submitting changes", "submitting a pull request", "development setup", "how to contribute", "ways to contribute"),
        (
            Section("How to Contribute", ("contributing", "ways to contribute", "getting started"), True),
            Section("Development Setup", ("development", "building", "local development", "setup", "getting started"), True),
            Section("Pull Request Process", ("pull requests", "pull request", "submitting changes", "submitting a pull request", "opening a pull request", "making changes"), True),
            Section("Reporting Bugs", ("reporting issues", "bug reports", "issues", "filing issues"), True),
            Section("Code of Conduct", (), False),
            Section("Style Guide", ("coding style", "code style", "coding conventions"), False),
            Section("Testing", ("tests", "running tests"), False),
        ),
    ),
    Kind(
        "code-of-conduct", "Code of Conduct", (r"(^|\/)\.github(\/|$)",), (), (r"^code[-_]?of[-_]?conduct(\.[a-z-]+)?\.(md|mdx|rst|txt)$",),
        ("our pledge", "pledge", "our standards", "standards", "expected behavior", "unacceptable behavior", "our responsibilities", "enforcement", "enforcement responsibilities", "enforcement guidelines", "scope", "reporting", "attribution"),
        ("our pledge", "our standards", "enforcement guidelines", "enforcement responsibilities"),
        (
            Section("Our Pledge", ("pledge",), True),
            Section("Our Standards", ("standards", "expected behavior", "our responsibilities"), True),
            Section("Enforcement", ("reporting", "reporting guidelines", "enforcement responsibilities"), True),
            Section("Scope", (), False),
            Section("Attribution", (), False),
        ),
    ),
    Kind(
        "governance", "Governance", (r"(^|\/)\.github(\/|$)", r"(^|\/)docs\/governance(\/|$)"), (), (r"^governance(\.[a-z-]+)?\.(md|mdx|rst|txt)$",),
        ("roles", "roles and responsibilities", "project roles", "responsibilities", "decision making", "decision-making", "decision-making process", "how decisions are made", "maintainers", "becoming a maintainer", "becoming a committer", "committers", "contributors", "meetings", "voting", "code of conduct", "amendments", "changing this document"),
        ("decision-making process", "becoming a maintainer", "becoming a committer", "roles and responsibilities"),
        (
            Section("Roles", ("roles and responsibilities", "project roles", "responsibilities"), True),
            Section("Decision Making", ("decision-making", "decision-making process", "decisions", "how decisions are made"), True),
            Section("Maintainers", ("becoming a maintainer", "becoming a committer", "committers"), True),
            Section("Meetings", (), False),
            Section("Code of Conduct", (), False),
            Section("Changing This Document", ("amendments", "changing the governance"), False),
        ),
    ),
    Kind(
        "security", "Security policy", (r"(^|\/)\.github(\/|$)", r"(^|\/)docs\/security(\/|$)"), (), (r"^security(\.[a-z-]+)?\.(md|mdx|rst|txt)$",),
        ("supported versions", "supported version", "reporting a vulnerability", "reporting security issues", "reporting a security issue", "report a vulnerability", "how to report", "disclosure", "disclosure policy", "coordinated disclosure", "responsible disclosure", "security updates", "response", "scope", "safe harbor", "preferred languages"),
        ("supported versions", "reporting a vulnerability", "coordinated disclosure", "disclosure policy"),
        (
            Section("Supported Versions", ("supported version", "affected versions"), True),
            Section("Reporting a Vulnerability", ("reporting security issues", "reporting a security issue", "report a vulnerability", "how to report"), True),
            Section("Disclosure Policy", ("disclosure", "coordinated disclosure", "responsible disclosure"), False),
            Section("Security Update Policy", ("security updates", "response"), False),
        ),
    ),
)
BY_TYPE = {k.type: k for k in KINDS}
WEAK_NAME, NAMED = compiled(r"^\d{1,8}[-_].+\.(md|mdx)$", "i"), compiled("(adr|rfc|rfd|runbook|playbook|postmortem|design|proposal)", "i")
FRONT = compiled(r"^(---|\+\+\+)\r?\n([\s\S]*?)\r?\n\1(?:\r?\n|$)")
PAIR = compiled(r"^([A-Za-z0-9_-]+)\s*[:=]\s*(.+?)\s*$")
LEAST = 4
#: Site generators: a file that names each, and what else has to be there.
PLATFORMS = (
    ("mkdocs", (r"^mkdocs\.ya?ml$",), ()),
    ("docusaurus", (r"^((website|docs)\/)?docusaurus\.config\.(js|ts|mjs|cjs)$",), ()),
    ("sphinx", (r"^(docs?|source)\/conf\.py$",), ()),
    ("hugo", (r"^hugo\.(toml|ya?ml|json)$", r"^config\/_default\/hugo\.(toml|ya?ml|json)$"), ()),
    ("jekyll", (r"^_config\.ya?ml$",), ()),
    ("mdbook", (r"^book\.toml$",), ()),
    ("antora", (r"^antora-playbook\.ya?ml$", r"^antora\.ya?ml$"), ()),
    ("docsify", (r"^docs\/_sidebar\.md$",), ()),
    ("vitepress", (r"(^|\/)\.vitepress\/config\.(js|ts|mjs|mts)$",), ()),
    ("starlight", (r"^astro\.config\.(mjs|js|ts)$",), (r"^src\/content\/docs\/",)),
    ("gitbook", (r"^\.gitbook\.ya?ml$", r"^book\.json$"), ()),
    ("readthedocs", (r"^\.readthedocs\.ya?ml$", r"^readthedocs\.ya?ml$"), ()),
)


def hit(patterns, text: str) -> bool:
    return any(compiled(p, "i").search(text) for p in patterns)


def has(names: list[str], aliases) -> bool:
    return any(n == a or n.startswith(a + " ") for n in names for a in aliases)


def front_matter(text: str) -> dict[str, str]:
    m = FRONT.match(text)
    pairs = (PAIR.match(x) for x in m[2].split("\n")) if m else ()
    return {p[1].lower(): re.sub("^[\"']|[\"']$", "", p[2]).lower() for p in pairs if p}


def kind_of(path: str, text: str, names: list[str]) -> tuple[str, int] | None:
    """Type and score of the best archetype: folders, file names, status and headings count; one telling sign is needed."""
    path = path.replace("\\", "/")
    base, status, found = path.split("/")[-1], front_matter(text).get("status"), []
    for k in KINDS:
        signs = [(hit(k.folders, path), 3), (hit(k.exact, base), 4), (status in k.statuses, 3)]
        named = hit(k.files, base)
        weak = named and WEAK_NAME.match(base) and not NAMED.search(base)
        markers = sum(has(names, (m,)) for m in k.markers)
        score = sum(n for yes, n in signs if yes) + (1 if weak else 3 if named else 0) + 2 * min(markers, 3)
        if score >= LEAST and (any(yes for yes, _ in signs) or named and not weak or has(names, k.strong)):
            found.append((k.type, score))
    return max(found, key=lambda x: x[1]) if found else None


def missing(doc: Document, type_: str) -> list[tuple]:
    """(rule, severity, offset, length, line, col, span, message) of sections that a document of the type lacks, and of blame in a postmortem."""
    kind = BY_TYPE.get(type_)
    if not kind:
        return []
    names = [plain(h.text) for h in doc.headings]
    at = doc.headings[0].start if doc.headings else 0
    out = []
    for s in kind.sections:
        there = has(names, s.aliases) or s.field and any(compiled(rf"^[\s>*-]*{escaped(a)}\s*[:=]", "im").search(doc.text) for a in s.aliases)
        if not there:
            word = "required" if s.required else "recommended"
            out.append(("asset-missing-section", "warn" if s.required else "advisory", at, 0, *doc.place(at), s.name, f'{kind.label}: no {word} section "{s.name}"'))
    for p in kind.blame:
        if m := compiled(p, "i").search(doc.masked):
            out.append(("postmortem-blame", "advisory", m.start(), len(m[0]), *doc.place(m.start()), m[0], f'Blame in "{m[0]}"'))
    return out


FOUND = "struct<type:string,score:int,findings:array<struct<rule_id:string,severity:string,offset:int,length:int,line:int,col:int,span:string,message:string>>>"


def assets(files: DataFrame, expected: str | None = None) -> DataFrame:
    """path, type, score, findings of files (path, text) that are of an archetype; expected names a column that holds the type."""
    ship(files.sparkSession)
    names = ("rule_id", "severity", "offset", "length", "line", "col", "span", "message")
    kinds = (pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string())
    row = pa.struct(list(zip(names, kinds, strict=True)))

    @F.arrow_udf(FOUND)
    def look(paths: pa.Array, texts: pa.Array, types: pa.Array) -> pa.Array:
        out = []
        for path, text, given in zip(paths.to_pylist(), texts.to_pylist(), types.to_pylist(), strict=True):
            doc = Document(text or "")
            best = (given, 0) if given else kind_of(path or "", text or "", [plain(h.text) for h in doc.headings])
            out.append({"type": best and best[0], "score": best and best[1], "findings": [dict(zip(names, f, strict=True)) for f in missing(doc, best[0])] if best else []})
        return pa.array(out, pa.struct([("type", pa.string()), ("score", pa.int32()), ("findings", pa.list_(row))]))

    given = F.col(expected) if expected else F.lit(None).cast("string")
    return files.select("path", look("path", "text", given).alias("x")).select("path", "x.*").filter("type IS NOT NULL")


def platforms(paths: DataFrame) -> DataFrame:
    """id, files (the paths that name it) of the site generators that the tree paths (path) holds.  One pass sums up flags."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    any_of = lambda ps: F.lit(False) if not ps else clean.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps))
    rows = [F.struct(F.lit(name).alias("id"), any_of(signs).alias("sign"), F.array(*[any_of((n,)) for n in needs]).cast("array<boolean>").alias("needs"), F.lit(len(needs)).alias("n")) for name, signs, needs in PLATFORMS]
    hits = paths.select(clean.alias("path"), F.inline(F.array(*rows))).filter("sign OR exists(needs, x -> x)")
    out = hits.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("sign"), F.col("path")))).alias("files"), F.max(F.size(F.filter("needs", lambda x: x))).alias("met"), F.max("n").alias("n"))
    return out.filter("size(files) > 0 AND met >= n").select("id", "files")


#: Files of a first site for each generator that can be set up, as (path, content) with {name} to fill in.
STARTERS = {
    "mkdocs": (("mkdocs.yml", "site_name: {name}\nnav:\n  - Home: index.md\n"), ("docs/index.md", "# {name}\n")),
    "docusaurus": (("docusaurus.config.js", "module.exports = {{ title: '{name}', url: 'https://example.org', baseUrl: '/', presets: ['classic'] }};\n"), ("docs/intro.md", "# {name}\n")),
    "sphinx": (("docs/conf.py", "project = '{name}'\nextensions = ['myst_parser']\n"), ("docs/index.md", "# {name}\n")),
    "hugo": (("hugo.toml", "title = '{name}'\nbaseURL = 'https://example.org/'\n"), ("content/_index.md", "# {name}\n")),
    "jekyll": (("_config.yml", "title: {name}\n"), ("index.md", "# {name}\n")),
    "mdbook": (("book.toml", "[book]\ntitle = '{name}'\n"), ("src/SUMMARY.md", "# Summary\n\n- [{name}](index.md)\n"), ("src/index.md", "# {name}\n")),
    "antora": (("antora.yml", "name: docs\ntitle: {name}\nversion: ~\nnav:\n- modules/ROOT/nav.adoc\n"), ("modules/ROOT/nav.adoc", "* xref:index.adoc[]\n"), ("modules/ROOT/pages/index.adoc", "= {name}\n")),
    "docsify": (("docs/_sidebar.md", "- [{name}](/)\n"), ("docs/README.md", "# {name}\n")),
}


def starter(platform: str, name: str = "Docs") -> list[tuple[str, str]]:
    """(path, content) of a first site."""
    return [(p, t.format(name=name)) for p, t in STARTERS[platform]]


def template(type_: str, title: str = "Title") -> str:
    """A document of an archetype with a heading for each of its sections."""
    kind = BY_TYPE[type_]
    parts = [f"## {s.name}\n\n{'Required' if s.required else 'Recommended'}: write it here.\n" for s in kind.sections if not s.field]
    fields = "".join(f"{s.name}: {kind.statuses[0] if kind.statuses else ''}\n\n" for s in kind.sections if s.field)
    return f"# {title}\n\n{fields}" + "\n".join(parts)
