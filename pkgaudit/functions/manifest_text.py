"""Dependencies named in one manifest's text, as an array expression over its content.

Every kind is a Column from text to array<struct<name, version, version_spec, is_dev, is_pinned>>.
Block formats are cut into sections with one split and read section by section, so a manifest is
handled inside its own row: no line table, no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgaudit.functions.json_text import is_json
from pkgaudit.functions.versions import clean_version

ENTRY = "struct<name:string,version:string,version_spec:string,is_dev:boolean,is_pinned:boolean>"
ENTRIES = f"array<{ENTRY}>"

END_OF_LINE = r"[ \t\r]*$"


def entry(name: Column, version: Column, spec: Column, dev, pinned) -> Column:
    def flag(x):
        return x if isinstance(x, Column) else F.lit(x).cast("boolean")

    return F.struct(
        name.alias("name"), version.alias("version"), spec.alias("version_spec"),
        flag(dev).alias("is_dev"), flag(pinned).alias("is_pinned"),
    )


def none() -> Column:
    return F.array().cast(ENTRIES)


def joined(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a.cast(ENTRIES), none()) for a in arrays])


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))


def matching(text: Column, pattern: str, build) -> Column:
    """Entries built from the trimmed lines that match a pattern."""
    return F.transform(F.filter(trimmed_lines(text), lambda line: line.rlike(pattern)), build)


def group(line: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(line, pattern, index)


def package_json(text: Column) -> Column:
    doc = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")

    def part(field: str, dev: bool) -> Column:
        return F.transform(
            F.map_entries(doc[field]),
            lambda e: entry(e["key"], clean_version(e["value"]), e["value"], dev, None),
        )

    return joined(part("dependencies", False), part("devDependencies", True))


def package_lock(text: Column) -> Column:
    fields = "struct<version:string,dev:boolean>"
    doc = F.from_json(text, f"packages map<string,{fields}>, dependencies map<string,{fields}>")

    def part(entries: Column, name) -> Column:
        usable = F.filter(
            entries, lambda e: (name(e["key"]) != "") & (F.coalesce(e["value"]["version"], F.lit("")) != "")
        )
        return F.transform(
            usable,
            lambda e: entry(
                name(e["key"]), e["value"]["version"], e["value"]["version"],
                F.coalesce(e["value"]["dev"], F.lit(False)), True,
            ),
        )

    last_segment = lambda key: F.element_at(F.split(key, "node_modules/"), -1)
    return joined(
        part(F.map_entries(doc["packages"]), last_segment),
        part(F.map_entries(doc["dependencies"]), lambda key: key),
    )


def yarn_lock(text: Column) -> Column:
    header = r'^"?((?:@[^@\s/]+/)?[^@\s]+)@(.+?)"?:?\s*(?:\n|$)'
    chunks = F.transform(
        F.filter(F.split(text, r"\n(?=[^ \t\r\n])"), lambda c: c.rlike(r"^[^\s#]")),
        lambda c: F.get(F.split(c, r"\n[ \t\r]*(?:#|\n|\z)", 2), F.lit(0)),
    )

    def version(chunk: Column) -> Column:
        return group(group(chunk, r"(?m)^[ \t]*(version[^\n]*)", 1), r'version\s+"([^"]+)"', 1)

    def name(chunk: Column) -> Column:
        raw = group(chunk, header, 1)
        return F.when(
            raw.startswith("npm:"), F.substring_index(F.regexp_replace(raw, "^npm:", ""), "@", 1)
        ).otherwise(raw)

    usable = F.filter(chunks, lambda c: (group(c, header, 1) != "") & (version(c) != ""))
    return F.transform(
        usable,
        lambda c: entry(name(c), version(c), version(c), c.rlike(r"(?m)^[ \t]*dev: true" + END_OF_LINE), True),
    )


def pnpm_lock(text: Column) -> Column:
    line = r"""^['"]?/?((?:@[^@/'"]+/)?[^@/'"][^@'"]*)@(.+?)['"]?:$"""
    after = F.get(F.split(text, r"(?m)^[ \t]*packages:" + END_OF_LINE, 2), F.lit(1))
    section = F.get(F.split(after, r"(?m)^(?!packages:)[a-z]+:" + END_OF_LINE, 2), F.lit(0))
    return matching(
        section, line, lambda t: entry(group(t, line, 1), group(t, line, 2), group(t, line, 2), None, True)
    )


def _at(token: Column, place: Column) -> Column:
    """What stands in front of and behind the at-sign at a place; 0 is no place."""
    return F.struct(
        F.substring(token, F.lit(1), place - 1).alias("name"),
        F.substring(token, place + 1, F.length(token)).alias("version"), (place > 1).alias("split"))


def _complete(parts: Column) -> Column:
    return parts["split"] & (parts["name"] != "") & (parts["version"] != "")


def bun_lock(text: Column) -> Column:
    """JSON locks name a package and version in each key, split at the last at-sign; text locks begin a line with
    them, split at the first one behind a scope's."""
    packages = F.map_entries(F.from_json(text, "packages map<string,string>")["packages"])

    def of_key(e: Column) -> Column:
        token = F.regexp_replace(e["key"], "^npm:", "")
        dev = F.coalesce(F.get_json_object(e["value"], "$.dev") == "true", F.lit(False))
        last = F.length(token) - F.length(F.substring_index(token, "@", -1))
        return F.struct(_at(token, last).alias("parts"), dev.alias("dev"))

    def of_line(line: Column) -> Column:
        token = F.regexp_replace(F.regexp_extract(line, r"^[^\s,]*", 0), "^npm:", "")
        return F.struct(_at(token, F.locate("@", token, 2)).alias("parts"), F.lit(None).cast("boolean").alias("dev"))

    def entries(found: Column) -> Column:
        return F.transform(F.filter(found, lambda f: _complete(f["parts"])), lambda f: entry(
            f["parts"]["name"], f["parts"]["version"], f["parts"]["version"], f["dev"], True))

    nested = F.filter(packages, lambda e: F.trim(e["value"]).substr(1, 1).isin("{", "["))
    lines = F.filter(trimmed_lines(text), lambda line: ~line.startswith("#"))
    return F.when(is_json(text), entries(F.transform(nested, of_key))).otherwise(entries(F.transform(lines, of_line)))


def requirements(text: Column) -> Column:
    name = r"^([A-Za-z0-9_.-]+)"
    full = name + r"(?:\[[^\]]+\])?(?:\s*([>=<~!]+)\s*|\s+)([^\s,#]+)"

    def build(line: Column) -> Column:
        version = F.when(line.rlike(full), group(line, full, 3)).otherwise(F.lit("*"))
        spec = F.when(line.rlike(full), F.concat(group(line, full, 2), group(line, full, 3))).otherwise(F.lit("*"))
        return entry(group(line, name, 1), version, spec, False, None)

    return matching(text, r"^(?![#-])[A-Za-z0-9_.-]+", build)


def _sections(text: Column) -> Column:
    """Parts of a TOML text, each starting at its header line."""
    return F.split(text, r"(?m)^[ \t]*(?=\[[^\n]*\][ \t\r]*$)")


def _section_name(part: Column) -> Column:
    return group(part, r"^\[([^\n]*)\][ \t\r]*(?:\n|\z)", 1)


# TOML: a bare or quoted key, a string on one line, and an array of strings with comments.
TOML_KEY = r"""(?:[\w-]++|"[^"\n]++"|'[^'\n]++')"""
TOML_STRING = r"""(?:"[^"\n]*+"|'[^'\n]*+')"""
TOML_STRINGS = rf"\[((?:[\s,]|#[^\n]*+|{TOML_STRING})*+)\]"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["']|["']$""", "")


def _strings_in(body: Column) -> Column:
    """The strings of a TOML array, without those in comments."""
    found = F.regexp_extract_all(body, F.lit(rf"#[^\n]*|({TOML_STRING})"), F.lit(1))
    return F.transform(F.filter(found, lambda t: t != ""), _unquoted)


# A distribution's name begins and ends with a letter or digit (PEP 508).
PEP508_NAME = r"^\s*([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)"


def requirement_name(text: Column) -> Column:
    """Name of a PEP 508 requirement; '' where there is none."""
    return F.regexp_extract(text, PEP508_NAME, 1)


def requirement_specifier(text: Column) -> Column:
    """Version clauses of a PEP 508 requirement without blanks and brackets; extras, marker and address are left out."""
    rest = F.regexp_replace(F.substring_index(text, ";", 1), PEP508_NAME + r"\s*(?:\[[^\]]*\])?", "")
    clauses = F.regexp_replace(rest, r"[\s()]", "")
    return F.when(clauses.startswith("@"), F.lit("")).otherwise(clauses)


def pyproject(text: Column) -> Column:
    """The arrays of requirements under [project] and its optional dependencies, and tables that give a
    specifier to each name."""
    pair = rf"^({TOML_KEY})(?:\[[^\]]*\])?\s*=\s*({TOML_STRING})"

    def optional(part: Column) -> Column:
        return _section_name(part).startswith("project.optional-dependencies")

    def of_table(part: Column) -> Column:
        def build(line: Column) -> Column:
            spec = _unquoted(group(line, pair, 2))
            return entry(_unquoted(group(line, pair, 1)), spec, spec, optional(part), None)

        return matching(part, pair, build)

    def of_arrays(part: Column) -> Column:
        key = F.when(optional(part), F.lit(TOML_KEY)).otherwise(F.lit("dependencies"))
        bodies = F.regexp_extract_all(part, F.concat(F.lit(r"(?m)^[ \t]*"), key, F.lit(r"[ \t]*=\s*" + TOML_STRINGS)), F.lit(1))
        named = F.filter(F.flatten(F.transform(bodies, _strings_in)), lambda t: requirement_name(t) != "")

        def build(t: Column) -> Column:
            spec = F.coalesce(F.nullif(requirement_specifier(t), F.lit("")), F.lit("*"))
            return entry(requirement_name(t), spec, spec, optional(part), None)

        return F.transform(named, build)

    name = _section_name
    tables = F.filter(_sections(text), lambda p: (name(p) == "project.dependencies") | optional(p))
    arrays = F.filter(_sections(text), lambda p: (name(p) == "project") | optional(p))
    return joined(F.flatten(F.transform(tables, of_table)), F.flatten(F.transform(arrays, of_arrays)))


def pipfile(text: Column) -> Column:
    doc = F.from_json(text, "packages map<string,string>, `dev-packages` map<string,string>")

    def part(field: str, dev: bool) -> Column:
        def build(e: Column) -> Column:
            version = F.when(
                e["value"].rlike(r"^\s*\{"), F.coalesce(F.get_json_object(e["value"], "$.version"), F.lit(""))
            ).otherwise(e["value"])
            return entry(e["key"], version, version, dev, None)

        return F.transform(F.map_entries(doc[field]), build)

    return joined(part("packages", False), part("dev-packages", True))


def cargo_toml(text: Column, nested_sections: bool = False) -> Column:
    """Crate requirements; with nested_sections also target-specific tables, and '*' for no version.

    A crate is a line of a dependency table (a version, or an inline table that may hold one), a dotted key, or
    a table of its own.
    """
    value = rf"^({TOML_KEY})\s*=\s*({TOML_STRING}|\{{.*)"
    dotted = rf"^({TOML_KEY})\.version\s*=\s*({TOML_STRING})"
    version_in = rf"(?m)(?:^|[\s{{,])version\s*=\s*({TOML_STRING})"
    own_table = rf"^(.*?dependencies)\.({TOML_KEY})$"
    missing = F.lit("*" if nested_sections else "")

    def is_dev(table: Column) -> Column:
        return table.isin("dev-dependencies", "build-dependencies")

    def is_read(table: Column) -> Column:
        plain = (table == "dependencies") | is_dev(table)
        return plain | table.endswith(".dependencies") if nested_sections else plain

    def crate(key: Column, version: Column, table: Column) -> Column:
        known = F.coalesce(F.nullif(_unquoted(version), F.lit("")), missing)
        return entry(_unquoted(key), known, known, is_dev(table), None)

    def of_table(part: Column) -> Column:
        def build(line: Column) -> Column:
            inline = group(line, value, 2)
            version = F.when(line.rlike(dotted), group(line, dotted, 2)).when(
                inline.startswith("{"), group(inline, version_in, 1)).otherwise(inline)
            key = F.when(line.rlike(dotted), group(line, dotted, 1)).otherwise(group(line, value, 1))
            return crate(key, version, _section_name(part))

        return matching(part, f"{value}|{dotted}", build)

    def of_own(part: Column) -> Column:
        table = group(_section_name(part), own_table, 1)
        return crate(group(_section_name(part), own_table, 2), group(part, version_in, 1), table)

    parts = _sections(text)
    own = F.filter(parts, lambda p: is_read(group(_section_name(p), own_table, 1)))
    return joined(F.flatten(F.transform(F.filter(parts, lambda p: is_read(_section_name(p))), of_table)), F.transform(own, of_own))


def _pairs(items: Column) -> Column:
    usable = F.filter(
        items,
        lambda p: (F.coalesce(p["name"], F.lit("")) != "") & (F.coalesce(p["version"], F.lit("")) != ""),
    )
    return F.transform(usable, lambda p: entry(p["name"], p["version"], p["version"], False, True))


def cargo_lock(text: Column) -> Column:
    listed = F.from_json(text, "packages array<struct<name:string,version:string>>")["packages"]
    blocks = F.slice(F.split(text, r"(?m)^[ \t]*\[\[package\]\]" + END_OF_LINE), 2, 1 << 30)
    parsed = F.transform(blocks, lambda b: F.struct(
        group(b, r'(?m)^[ \t]*name\s*=\s*"([^"]+)"', 1).alias("name"),
        group(b, r'(?m)^[ \t]*version\s*=\s*"([^"]+)"', 1).alias("version")))
    return F.when(is_json(text), _pairs(listed)).otherwise(_pairs(parsed))


def go_mod(text: Column) -> Column:
    single = r"^require\s+([^\s(]\S*)\s+(\S+)"
    line = r"^(?!//)(\S+)\s+(\S+)"
    blocks = F.regexp_extract_all(
        text, F.lit(r"(?ms)^[ \t]*require \([^\n]*\n(.*?)(?:^[ \t]*\)[ \t\r]*$|\z)"), F.lit(1)
    )

    def build(pattern: str):
        return lambda t: entry(
            group(t, pattern, 1), group(t, pattern, 2), group(t, pattern, 2), t.contains("// indirect"), None
        )

    return joined(
        matching(text, single, build(single)),
        F.flatten(F.transform(blocks, lambda b: matching(b, line, build(line)))),
    )


def go_sum(text: Column) -> Column:
    line = r"^(\S+)\s+(\S+)"
    return matching(text, line, lambda t: entry(group(t, line, 1), group(t, line, 2), group(t, line, 2), False, True))


def gemfile(text: Column) -> Column:
    """Calls of gem: a quoted name, then a quoted requirement or one under the key version; those in a
    development or test group are for development."""
    call = r"""^gem\b[\s(]*+(["'])(.+?)\1(?:\s*,\s*(["'])(.+?)\3(?!\s*=>))?"""
    keyed = r"""\bversion:\s*(["'])(.+?)\1"""
    parts = F.split(text, r"(?m)^[ \t]*(?=group|end[ \t\r]*$)")

    def dev(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return head.startswith("group") & (head.contains(":development") | head.contains(":test"))

    def calls(part: Column) -> Column:
        def build(line: Column) -> Column:
            version = F.coalesce(F.nullif(group(line, call, 4), F.lit("")), group(line, keyed, 2))
            return entry(group(line, call, 2), version, version, dev(part), None)

        return matching(part, call, build)

    return F.flatten(F.transform(parts, calls))


def gemfile_lock(text: Column) -> Column:
    line = r"^([a-zA-Z0-9_-]+)\s*\(([0-9][^)]*)\)"
    listed = F.from_json(text, "specs array<struct<name:string,version:string>>")["specs"]
    chunks = F.slice(F.split(text, r"(?m)^[ \t]*specs:[ \t\r]*\n"), 2, 1 << 30)
    sections = F.transform(chunks, lambda c: F.get(
        F.split(c, r"(?m)^[ \t\r]*(?:$|PLATFORMS|BUNDLED WITH|DEPENDENCIES)", 2), F.lit(0)))

    def build(t: Column) -> Column:
        version = F.regexp_replace(F.trim(group(t, line, 2)), r"-[a-z][\w-]*$", "")
        return entry(group(t, line, 1), version, version, False, True)

    from_text = F.flatten(F.transform(sections, lambda s: matching(s, line, build)))
    return F.when(is_json(text), _pairs(listed)).otherwise(from_text)
