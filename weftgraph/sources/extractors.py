"""Facts of source files in languages with braces, by patterns over text whose comments and strings are blanked.

A declaration's body is the braces that open after it, which gives its lines and what it owns. The
patterns see one file at a time and know no types; a file whose braces don't match is one parse_error, not a guess.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|open|readonly|synchronized|virtual|inline|constexpr|export|default|const|external|suspend|get|set)\s+)*"
_CLASSLIKE = r"\b(?P<kind>class|interface|enum)\s+(?P<name>[\w$]+)(?:<[^{};]*?>)?(?P<bases>[^{};=]*)(?=\{)"
_TYPED_METHOD = rf"(?:(?m:^)|(?<=[{{}};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODIFIERS}(?:<[^<>]*>\s*)?(?:[\w$:.]+(?:<[^(){{}};]*>)?[\[\]?*&]*\s+[*&]*)?(?P<name>~?[\w$]+(?:::~?\w+)*)\s*(?P<parameters>\([^;{{}}]*\))\s*(?:const\s*|override\s*|noexcept\s*|async\s*|throws\s+[\w.,\s]+|:\s*[\w(),\s]+)*(?=\{{)"

# Words that look like declarations, and those that look like calls, and aren't.
CONTROL = frozenset(["if", "for", "while", "switch", "catch", "return", "throw", "new", "else", "do", "try", "synchronized", "using", "match", "when", "with", "function", "sizeof"])
KEYWORDS = CONTROL | frozenset(["async", "func", "fun", "fn", "typeof", "await", "guard", "defer", "case", "assert", "super", "constructor", "in", "is", "as", "and", "or", "not", "loop", "unsafe", "where", "import", "require", "delete", "yield"])


@dataclass(frozen=True)
class Language:
    """Patterns of declarations by kind, of imports (name, alias, detail), and how parameters are typed."""

    declarations: tuple[tuple[str, str], ...]
    imports: str
    typed: str = "first"  # type before the name; "after": name: Type; "go": name Type
    extends: str = r"\bextends\s+(?P<list>[\w$.,\s<>]+?)(?=\bimplements\b|\bwith\b|$)"
    implements: str = r"\b(?:implements|with)\s+(?P<list>[\w$.,\s<>]+?)(?=\bimplements\b|$)"
    char: str = r"'(?:\\.|[^'\\\n])*'"
    separators: str = r"[.,;]"
    owners: frozenset[str] = field(default=frozenset(["class", "interface", "enum", "impl"]))


_JS_METHOD = rf"(?:(?m:^)|(?<=[{{}};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODIFIERS}\*?\s*(?P<name>[#\w$]+)\s*(?:<[^(){{}}]*>)?(?P<parameters>\((?:[^(){{}};]|\([^()]*\))*\))\s*(?::\s*[^={{}};]+?)?\s*(?=\{{)"
_JS = Language(
    declarations=(
        ("", _CLASSLIKE), ("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(){}]*>)?(?P<parameters>\((?:[^(){};]|\([^()]*\))*\))"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?P<parameters>\((?:[^(){};]|\([^()]*\))*\)|[\w$]+)\s*(?::[^={};]+)?=>"),
        ("type", r"(?m)^[ \t]*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?="), ("method", _JS_METHOD),
    ),
    imports=r"""\b(?:import|export)\s+(?:type\s+)?(?P<names>[\w*{}\s,$]+?)\s+from\s+["'`](?P<from>[^"'`]+)["'`]|\bimport\s+["'](?P<bare>[^"']+)["']|\b(?:require|import)\(\s*["'](?P<called>[^"']+)["']\s*\)""",
    typed="after", char=r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
)
_PATHS = r"(?m)^[ \t]*import\s+(?:static\s+)?(?P<from>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?"
_COLON_BASES = r":\s*(?P<list>[^{]+)$"
LANGUAGES = {
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "java": Language((("", _CLASSLIKE.replace("enum)", "enum|record)")), ("method", _TYPED_METHOD)), _PATHS),
    "kotlin": Language((("", r"\b(?P<kind>class|interface|object)\s+(?P<name>\w+)(?:<[^{}]*?>)?(?:\([^{}]*?\))?(?P<bases>[^{}\n=]*)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>\w+)\s*(?P<parameters>\([^{}]*?\))")), _PATHS, "after", _COLON_BASES, r"(?!)"),
    "go": Language(
        (("", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\b"), ("function", r"\bfunc\s*(?:\((?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<parameters>\([^{}]*?\))")),
        r"""(?m)^[ \t]*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<from>[^"\n]+)"[ \t]*$""", "go", r"(?!)", r"(?!)", r"`[^`]*`"),
    "rust": Language(
        (("", r"\b(?P<kind>struct|enum|trait)\s+(?P<name>\w+)"), ("impl", r"\bimpl(?:<[^{}]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{}]*?>)?\s+for\s+)?(?P<name>\w+)"), ("function", r"\bfn\s+(?P<name>\w+)\s*(?:<[^{}]*?>)?(?P<parameters>\([^{}]*?\))")),
        r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<from>[\w:]+(?:::\{[^}]*\}|::\*)?)(?:\s+as\s+(?P<alias>\w+))?\s*;", "after", r"(?!)", r"(?!)", r"'(?:\\.|[^'\\\n])'"),
    "swift": Language((("", r"\b(?P<kind>class|struct|protocol|enum|extension)\s+(?P<name>\w+)(?:<[^{}]*?>)?(?P<bases>[^{}]*?)(?=\{)"), ("function", r"\bfunc\s+(?P<name>\w+)\s*(?:<[^{}]*?>)?(?P<parameters>\([^{}]*?\))")), r"(?m)^[ \t]*import\s+(?P<from>[\w.]+)", "after", _COLON_BASES, r"(?!)", r"(?!)"),
    "dart": Language((("", _CLASSLIKE.replace("class|", "class|mixin|")), ("method", _TYPED_METHOD)), r"""(?m)^[ \t]*(?:import|export)\s+["'](?P<from>[^"'\n]+)["'](?:\s+as\s+(?P<alias>\w+))?"""),
    "c": Language((("", r"\b(?P<kind>struct|enum)\s+(?P<name>\w+)\s*(?=\{)"), ("method", _TYPED_METHOD)), r"""(?m)^[ \t]*#\s*include\s*[<"](?P<from>[^>"\n]+)[>"]"""),
    "cpp": Language((("", r"\b(?P<kind>class|struct|enum)\s+(?P<name>\w+)(?P<bases>[^{};()]*)(?=\{)"), ("method", _TYPED_METHOD)), r"""(?m)^[ \t]*#\s*include\s*[<"](?P<from>[^>"\n]+)[>"]""", "first", r":\s*(?P<list>[^{]+)$", r"(?!)"),
}
# What a language calls its classes and interfaces.
KINDS = {"struct": "class", "object": "class", "record": "class", "mixin": "class", "extension": "impl", "trait": "interface", "protocol": "interface"}
_CALL = re.compile(r"(?<![\w$.])(?P<callee>[A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:<[\w$.,\s\[\]]*>)?\(")


def blanked(text: str, language: Language, strings: bool = True) -> str:
    """The text with comments, and strings if asked for, as blanks; lines and places stay."""
    pattern = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|" + language.char, re.DOTALL)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0].startswith(("//", "/*")) else m[0], text)


def braces(text: str) -> dict[int, int] | None:
    """Where each opening brace closes; None if they don't match."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif not open_:
            return None
        else:
            out[open_.pop()] = m.start()
    return None if open_ else out


def _split(listed: str) -> list[str]:
    """Names of a list, without type arguments, access words and constructor calls."""
    while (plain := re.sub(r"<[^<>]*>|\([^()]*\)", "", listed)) != listed:
        listed = plain
    words = [re.sub(r"^(?:public|private|protected|virtual)\s+", "", x.strip()) for x in listed.split(",")]
    return [w for w in words if re.fullmatch(r"[\w$.:]+", w)]


def _parameters(listed: str, typed: str) -> Iterator[tuple[str, str]]:
    """(name, type) of the parameters that have a type."""
    depth, parts, at = 0, [], 0
    inner = listed.strip()[1:-1] if listed.strip().startswith("(") else ""
    for i, c in enumerate(inner):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and not depth:
            parts.append(inner[at:i])
            at = i + 1
    for part in [*parts, inner[at:]]:
        part = re.sub(r"@\w+(?:\([^)]*\))?\s*|\b(?:final|const|mut|val|var|required|this\.|public|private|protected|readonly|inout)\s+", "", part.partition("=")[0]).strip()
        if typed == "after":
            m = re.match(r"(?:\w+\s+)?(?P<name>[\w$]+)\??\s*:\s*(?P<type>.+)$", part, re.DOTALL)
        elif typed == "go":
            m = re.match(r"(?P<name>\w+)\s+(?P<type>.+)$", part, re.DOTALL)
        else:
            m = re.match(r"(?P<type>.+?[\s*&>\]])\s*(?P<name>\w+)$", part, re.DOTALL)
        if m:
            yield m["name"], re.sub(r"\s+", " ", m["type"]).strip()


def _imports(path: str, text: str, language: Language, line_of) -> Iterator[tuple]:
    for m in re.finditer(language.imports, text):
        g = m.groupdict()
        source = g.get("from") or g.get("bare") or g.get("called")
        line = line_of(m.start(0) + len(m[0]) - len(m[0].lstrip()))
        row = lambda name, alias, line=line, source=source: (path, "import", name, alias, "", source, line, line)
        names = g.get("names")
        if names:
            listed = re.search(r"\{([^}]*)\}", names)
            for one in listed[1].split(",") if listed else ():
                name, _, alias = (x.strip() for x in one.strip().removeprefix("type ").partition(" as "))
                if name:
                    yield row(name, alias or None)
            rest = re.sub(r"\{[^}]*\}", "", names).strip(" ,\n\t")
            for one in filter(None, (x.strip() for x in rest.split(","))):
                yield row("*" if one.startswith("*") else "default", one.partition(" as ")[2].strip() or (None if one == "*" else one))
        elif source and (group := re.match(r"(.*)::\{(.*)\}$", source, re.DOTALL)):
            for one in group[2].split(","):
                name, _, alias = (x.strip() for x in one.partition(" as "))
                if name:
                    yield path, "import", name, alias or None, "", f"{group[1]}::{name}", line, line
        else:
            yield row(re.split(r"::|[./]", source)[-1] if g.get("from") else "*", g.get("alias"))


def brace_facts(path: str, text: str, language: str) -> Iterator[tuple]:
    """Facts of one file: symbols with their lines and owners, imports, calls, bases, typed parameters."""
    rules = LANGUAGES[language]
    plain = blanked(text, rules)
    closes = braces(plain)
    if closes is None:
        yield path, "parse_error", "", None, None, None, 1, 1
        return
    breaks = [m.start() for m in re.finditer("\n", text)]

    def line_of(at: int) -> int:
        low, high = 0, len(breaks)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if breaks[middle] < at else (low, middle)
        return low + 1

    opens = sorted(closes)
    found: dict[int, tuple] = {}
    for kind, pattern in rules.declarations:
        for m in re.finditer(pattern, plain):
            at = m.start("name")
            if at in found or m["name"] in CONTROL:
                continue
            body = next((o for o in opens if o >= m.end()), None)
            stop = re.compile(r"[;}]").search(plain, m.end())
            has_body = body is not None and (stop is None or body < stop.start())
            found[at] = (m, kind or KINDS.get(m["kind"], m["kind"]), body if has_body else None, closes[body] if has_body else m.end())
    yield from _imports(path, blanked(text, rules, strings=False), rules, line_of)

    scopes: list[tuple[int, str, str]] = []  # end, kind, qualified name

    def owner_of(at: int) -> tuple[str, str]:
        while scopes and scopes[-1][0] < at:
            scopes.pop()
        return (scopes[-1][1], scopes[-1][2]) if scopes else ("", "")

    calls = [(m.start("callee"), m) for m in _CALL.finditer(plain)]
    events = sorted([(at, 0, x) for at, x in found.items()] + [(at, 1, m) for at, m in calls if at not in found], key=lambda e: e[:2])
    for at, which, x in events:
        above, owner = owner_of(at)
        if which:
            name = x["callee"].replace("?.", ".").replace("->", ".")
            if re.split(r"\.|::", name)[0] not in KEYWORDS | {"constructor"} or "." in name and name.split(".")[0] == "super":
                yield path, "call", name, None, owner, None, line_of(at), line_of(at)
            continue
        m, kind, body, end = x
        if kind == "method" and above not in rules.owners and language in ("javascript", "typescript", "tsx"):
            continue  # a call with a block, not a method
        groups = m.groupdict()
        receiver = groups.get("receiver")
        inside = receiver or ("" if above not in rules.owners and kind in ("function", "method") and not owner else owner)
        name = m["name"].split("::")[-1]
        if "::" in m["name"]:
            inside = m["name"].rpartition("::")[0].replace("::", ".")
        if kind in ("function", "method"):
            kind = "method" if receiver or above in rules.owners or "::" in m["name"] else "function"
        qualified = f"{inside}.{name}" if inside else name
        if body is not None:
            scopes.append((end, kind, name if kind == "impl" else qualified))
        if kind != "impl":
            yield path, kind, name, qualified, inside, None, line_of(at), line_of(end)
        for relation, pattern in (("extends", rules.extends), ("implements", rules.implements)):
            if groups.get("bases") and (listed := re.search(pattern, groups["bases"].strip(), re.DOTALL)):
                for base in _split(listed["list"]):
                    yield path, "base", base, None, name if kind == "impl" else qualified, relation, line_of(at), line_of(at)
        if groups.get("trait"):
            yield path, "base", groups["trait"], None, name, "implements", line_of(at), line_of(at)
        for parameter, type_name in _parameters(groups.get("parameters") or "", rules.typed):
            yield path, "parameter", parameter, None, qualified, type_name, line_of(at), line_of(at)
