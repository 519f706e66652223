"""C++ declaration parser for reflection-annotated sources: one text in, typed records out.

One pass over the text: comments are blanked in place (so offsets and line numbers
hold), string contents are masked in a skeleton of equal length, and the skeleton's
brackets and semicolons cut the code into headers with a scope stack. Identifiers
are ASCII. Differences from naive line matching that are on purpose:

* a macro belongs to the declaration it precedes, on the same line or above;
* class bodies end at their own brace, enums on one line keep their last value;
* forward declarations and ``enum class`` are no classes;
* flags are compared as whole specifiers, not as substrings;
* ``_RetVal`` delegates take their name from the second argument;
* function declarations are those that end in ``;``, definitions are listed apart.
"""

from __future__ import annotations

import re
from bisect import bisect_right

CLASS_FLAGS = ["Abstract", "Blueprintable", "BlueprintType", "Config", "Const", "DefaultToInstanced", "Deprecated", "EditInlineNew", "MinimalAPI", "NotBlueprintable", "NotPlaceable", "Placeable", "Transient"]
PROPERTY_FLAGS = ["AdvancedDisplay", "AssetRegistrySearchable", "BlueprintAssignable", "BlueprintCallable", "BlueprintReadOnly", "BlueprintReadWrite", "Config", "DuplicateTransient", "EditAnywhere", "EditDefaultsOnly", "EditFixedSize", "EditInstanceOnly", "Export", "GlobalConfig", "Instanced", "Interp", "Localized", "NonTransactional", "Replicated", "SaveGame", "Transient", "VisibleAnywhere", "VisibleDefaultsOnly"]
FUNCTION_FLAGS = ["BlueprintAuthorityOnly", "BlueprintCallable", "BlueprintCosmetic", "BlueprintGetter", "BlueprintImplementableEvent", "BlueprintNativeEvent", "BlueprintPure", "BlueprintSetter", "CallInEditor", "Client", "Exec", "NetMulticast", "Reliable", "Server"]
CALLABLE = {"BlueprintCallable", "BlueprintPure", "BlueprintImplementableEvent", "BlueprintNativeEvent"}
KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "case", "new", "delete", "throw", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "decltype", "alignof", "typeid", "operator", "void", "class", "struct", "enum", "using", "typedef", "namespace", "template", "typename", "static_assert", "defined"}
_MACROS = {"UCLASS": "class", "USTRUCT": "struct", "UINTERFACE": "interface", "UENUM": "enum", "UPROPERTY": "property", "UFUNCTION": "function", "UDELEGATE": "delegate"}
_VOCABULARY = {"class": CLASS_FLAGS + ["BlueprintType"], "struct": CLASS_FLAGS, "interface": CLASS_FLAGS, "enum": CLASS_FLAGS, "property": PROPERTY_FLAGS, "function": FUNCTION_FLAGS, "delegate": FUNCTION_FLAGS}


def split_params(text: str) -> list[str]:
    """Splits at commas outside of any bracket or string; parts are stripped, empty ones dropped."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == '"' and text[i - 1 : i] != "\\":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "<([{":
            depth += 1
        elif c in ">)]}" and not (c == ">" and text[i - 1 : i] == "-"):
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def parse_parameters(text: str) -> list[dict]:
    """type, name, default of each parameter; ``void`` or nothing: none; without a name: type ``unknown`` and the text as name."""
    if text.strip() in ("", "void"):
        return []
    out = []
    for p in split_params(text):
        left, _, default = p.partition("=")
        m = _PARAMETER.match(left.strip())
        out.append({"type": squeeze(m[1]) if m else "unknown", "name": m[2] if m else left.strip(), "default": default.strip() or None})
    return out


def squeeze(text: str) -> str:
    return " ".join(text.split())


def parse_specifiers(text: str, kind: str) -> dict:
    """flags (known ones, in the vocabulary's order), category, meta of a macro's argument list."""
    parts = split_params(text)
    names = {p.partition("=")[0].strip() for p in parts}
    category, meta = None, {}
    for p in parts:
        key, _, value = (x.strip() for x in p.partition("="))
        if key == "Category" and (value.startswith('"') or kind == "property"):
            category = value.strip('"')
        elif key.lower() == "meta":
            for q in split_params(value.strip().removeprefix("(").removesuffix(")")):
                k, _, v = (x.strip() for x in q.partition("="))
                meta[k] = v.strip('"') or "true"
    return {"flags": [f for f in dict.fromkeys(_VOCABULARY[kind]) if f in names], "category": category, "meta": meta}


_LEX = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def strip_comments(text: str) -> str:
    """The text with comments blanked, every line and column in place; strings are kept."""
    return _LEX.sub(lambda m: _blank(m[0]) if m[0][0] == "/" else m[0], text)


def _doc_text(raw: str) -> str:
    lines = [re.sub(r"^\s*(/\*\*+|\*+/|\*|///)?\s?", "", l).replace("*/", "").strip() for l in raw.split("\n")]
    return " ".join(l for l in lines if l)


def doc_comments(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, text) of ``/** */`` comments and of runs of ``///`` lines."""
    out: list[tuple[int, int, str]] = []
    for m in _LEX.finditer(text):
        raw = m[0]
        if raw.startswith("/**") and raw != "/**/":
            out.append((m.start(), m.end(), _doc_text(raw)))
        elif raw.startswith("///"):
            if out and out[-1][2] and text[out[-1][0]] == "/" and text[out[-1][0] : out[-1][0] + 3] == "///" and not text[out[-1][1] : m.start()].strip() and text.count("\n", out[-1][1], m.start()) == 1:
                out[-1] = (out[-1][0], m.end(), out[-1][2] + " " + _doc_text(raw))
            else:
                out.append((m.start(), m.end(), _doc_text(raw)))
    return out


def doc_lines(text: str) -> list[tuple[int, str]]:
    """(line that follows the comment, its text): what a declaration there is documented by."""
    return [(text.count("\n", 0, e) + 2, t) for _, e, t in doc_comments(text)]


_CLASS = re.compile(r"(?:^|\s)(class|struct)\s+(?:alignas\s*\([^)]*\)\s*)?(?:[A-Z][A-Z0-9_]*_API\s+)?([A-Z]\w*)\s*(?:final\s*)?(?::(?!:)\s*(.*))?$", re.S)
_ENUM = re.compile(r"(?:^|\s)enum\s+(?:class\s+|struct\s+)?([A-Za-z_]\w*)\s*(?::\s*([\w:]+))?\s*$", re.S)
_FUNC = re.compile(r"^(?P<pre>.*?[\s*&>])?(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\((?P<args>.*)\)(?P<post>[^()]*)$", re.S)
_PROP = re.compile(r"^(?P<type>[\w:<>,\s*&]+?[\s*&>])(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=\s*(?P<value>.*))?$", re.S)
_DELEGATE = re.compile(r"\bDECLARE_(DYNAMIC_)?(MULTICAST_)?(?:SPARSE_)?DELEGATE(_RetVal)?(?:_(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine)Params?)?\s*\(")
_MACRO = re.compile(r"\b(" + "|".join(_MACROS) + r")\s*\(")
_CUT = re.compile(r"[(){};]")
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]+["<]([^">\n]+)[">]', re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", re.M)
_ACCESS = re.compile(r"^(\s*(?:public|protected|private)\s*:(?!:))+")
_NAMESPACE = re.compile(r"(?:inline\s+)?namespace\s*([\w:]*)\s*$")
_USING = re.compile(r"using\s+([A-Za-z_]\w*)\s*=\s*(.+)$", re.S)
_TYPEDEF = re.compile(r"typedef\s+(.+?)\s*\b([A-Za-z_]\w*)$", re.S)
_PURE, _DELETE = re.compile(r"=\s*0\s*$"), re.compile(r"=\s*delete")
_ASSIGN = re.compile(r"(?<![=!<>])=(?!=)")
_QUALIFIER = re.compile(r"\b(?:virtual|static|inline|explicit|constexpr|FORCEINLINE|[A-Z][A-Z0-9]*_API)\b")
_CONST, _OVERRIDE, _FINAL = (re.compile(rf"\b{w}\b") for w in ("const", "override", "final"))
_PARAMETER = re.compile(r"^(.*[\s&*>])\s*([A-Za-z_]\w*)\s*(\[\w*\])?$", re.S)
_BODY_MACRO = re.compile(r"\b(?:GENERATED_(?:U\w+_)?BODY|DECLARE_\w+|IMPLEMENT_\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)")


class _Source:
    def __init__(self, text: str):
        self.text = text
        self.docs = doc_comments(text)
        self.code = strip_comments(text)
        self.includes = [(m.start(), m[1]) for m in _INCLUDE.finditer(self.code)]
        self.code = _DIRECTIVE.sub(lambda m: _blank(m[0]), self.code)
        self.mask = _LEX.sub(lambda m: m[0] if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], self.code)
        self.newlines = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_right(self.newlines, at - 1) + 1

    def close(self, at: int, pair: str = "()") -> int:
        """The place of the bracket that closes the one at ``at``, or the end."""
        depth = 0
        for m in re.compile(f"[{re.escape(pair)}]").finditer(self.mask, at):
            depth += 1 if m[0] == pair[0] else -1
            if not depth:
                return m.start()
        return len(self.mask)


def _bases(text: str) -> list[str]:
    out = []
    for p in split_params(text):
        p = squeeze(re.sub(r"\b(?:public|protected|private|virtual)\b", " ", p))
        if p:
            out.append(p)
    return out


def is_interface_name(name: str) -> bool:
    return re.match(r"I[A-Z]", name.split("::")[-1]) is not None


def _macros(src: _Source, a: int, b: int) -> tuple[str, int, dict[str, dict]]:
    """Header text without its macros, where it begins, and the macros' specifiers by kind."""
    found, at = {}, a
    pieces = []
    while m := _MACRO.search(src.mask, at, b):
        end = src.close(m.end() - 1)
        kind = _MACROS[m[1]]
        found[kind] = parse_specifiers(src.code[m.end() : end], kind)
        pieces.append((m.start(), min(end + 1, b)))
        at = min(end + 1, b)
    code = src.code[a:b]
    for x, y in pieces:
        code = code[: x - a] + _blank(code[x - a : y - a]) + code[y - a :]
    if "(" in code:
        code = _BODY_MACRO.sub(lambda m: _blank(m[0]), code)
    if ":" in code:
        code = _ACCESS.sub(lambda m: _blank(m[0]), code)
    lead = len(code) - len(code.lstrip())
    return code.strip(), a + lead, found


_KINDS = ("classes", "functions", "definitions", "enums", "delegates", "aliases", "includes")


def parse(text: str | None) -> dict[str, list[dict]]:
    """All records of a source text by kind; a null text has none."""
    out: dict[str, list[dict]] = {k: [] for k in _KINDS}
    if not text:
        return out
    src = _Source(text)
    out["includes"] = [{"include": name, "line": src.line(at)} for at, name in src.includes]
    for m in _DELEGATE.finditer(src.mask):
        args = split_params(src.code[m.end() : src.close(m.end() - 1)])
        ret = args.pop(0) if m[3] and args else None
        if args:
            kind = ("dynamic_" if m[1] else "") + ("multicast" if m[2] else "single")
            out["delegates"].append({"name": args[0], "kind": "dynamic" if kind == "dynamic_single" else kind, "return_type": ret, "params": args[1:], "line": src.line(m.start())})
    stack: list[tuple[str, object]] = []
    start = depth = i = 0
    skip = None
    for m in _CUT.finditer(src.mask):
        i, c = m.start(), m[0]
        if skip is not None:
            depth_in = skip[1] + (c == "{") - (c == "}")
            skip = (skip[0], depth_in)
            if not depth_in:
                skip[0](i)
                skip, start = None, i + 1
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif depth:
            continue
        elif c == "}":
            if stack:
                stack.pop()
            start = i + 1
        else:
            head, at, macros = _macros(src, start, i)
            doc = next((t for a, e, t in reversed(src.docs) if start <= a and e <= max(at, start) + len(head) and a < i), None)
            opened = c == "{"
            skip = _header(src, out, stack, head, at, macros, doc, opened, i)
            start = i + 1
    return out


def _space(stack) -> str:
    return "::".join(str(x) for kind, x in stack if kind == "ns")


def _owner(stack) -> dict | None:
    return stack[-1][1] if stack and stack[-1][0] == "class" else None


def _header(src, out, stack, head, at, macros, doc, opened, i):
    """Records what a header declares; for a body to pass over, what to do at its end, with depth 1."""
    owner = _owner(stack)
    if opened and (m := _NAMESPACE.match(head)):
        stack.append(("ns", m[1]) if m[1] else ("block", None))
        return None
    head = re.sub(r"^template\s*<[^;{]*?>\s*(?=class|struct|[A-Za-z_])", "", head) if head.startswith("template") else head
    if opened and (m := _ENUM.search(head)):
        rec = {"name": m[1], "underlying": m[2], "namespace": _space(stack), "values": [], "is_uenum": "enum" in macros, "flags": macros.get("enum", {}).get("flags", []), "doc": doc, "line": src.line(at + m.start(1))}
        out["enums"].append(rec)

        def values(end):
            for v in split_params(src.code[i + 1 : end]):
                name = re.match(r"[A-Za-z_]\w*", v)
                if name:
                    rec["values"].append(name[0])

        return (values, 1)
    if opened and "(" not in head.partition(":")[0] and (m := _CLASS.search(head)):
        bases = _bases(m[3] or "")
        inter = [b for b in bases if is_interface_name(b)]
        spec = macros.get("class") or macros.get("struct") or macros.get("interface") or {}
        plain = [b for b in bases if not is_interface_name(b)]
        rec = {
            "name": m[2], "namespace": _space(stack), "line": src.line(at + m.start(2)), "parent_class": (plain or bases or [None])[0], "parent_classes": plain, "interfaces": inter,
            "is_uclass": "class" in macros, "is_struct": m[1] == "struct", "is_interface": is_interface_name(m[2]) or "interface" in macros, "is_blueprintable": "Blueprintable" in spec.get("flags", []),
            "flags": spec.get("flags", []), "category": spec.get("category"), "doc": doc, "properties": [], "methods": [],
        }
        out["classes"].append(rec)
        stack.append(("class", rec))
        return None
    fn = _FUNC.match(head) if "(" in head else None
    if opened:
        if fn and fn["name"].split("::")[-1] not in KEYWORDS and not head.startswith(("if", "for", "while", "switch")):
            name = fn["name"].split("::")[-1]
            qualifier = "::".join(fn["name"].split("::")[:-1]) or (owner["name"] if owner else None)
            rec = {"name": name, "class_name": qualifier, "line": src.line(at), "body": ""}
            out["definitions"].append(rec)

            def body(end):
                rec["body"] = src.code[i + 1 : end]

            return (body, 1)
        stack.append(("block", None))
        return None
    if not head:
        return None
    if m := _USING.match(head):
        out["aliases"].append({"name": m[1], "underlying": squeeze(m[2]), "kind": "using", "line": src.line(at)})
    elif m := _TYPEDEF.match(head):
        out["aliases"].append({"name": m[2], "underlying": squeeze(m[1]), "kind": "typedef", "line": src.line(at)})
    elif head.startswith(("using ", "friend ", "return", "extern ", "class ", "struct ", "enum ", "goto ", "break", "continue", "#")):
        pass
    elif stack and stack[-1][0] == "block":
        pass
    elif fn and not _ASSIGN.search(fn["pre"] or "") and fn["name"].split("::")[-1] not in KEYWORDS and (fn["pre"] or owner):
        _function(src, out, stack, owner, fn, at, macros, doc)
    elif owner is not None and (m := _PROP.match(head)) and m["name"] not in KEYWORDS and squeeze(m["type"]).split(" ")[0] not in KEYWORDS - {"void"}:
        spec = macros.get("property")
        owner["properties"].append({"name": m["name"], "type": squeeze(m["type"]), "is_uproperty": spec is not None, "flags": (spec or {}).get("flags", []), "category": (spec or {}).get("category")})
    return None


def _function(src, out, stack, owner, fn, at, macros, doc):
    post = fn["post"].strip()
    if _DELETE.search(post):
        return
    words = (fn["pre"] or "").replace("*", " * ").replace("&", " & ").split()
    quals = {w for w in words if w in ("virtual", "static", "inline", "explicit", "constexpr", "FORCEINLINE")}
    ret = squeeze(_QUALIFIER.sub(" ", fn["pre"] or ""))
    params = parse_parameters(fn["args"])
    spec = macros.get("function", {})
    pure = _PURE.search(post) is not None
    rec = {
        "name": fn["name"].split("::")[-1], "class_name": owner["name"] if owner else None, "namespace": _space(stack), "return_type": ret, "parameters": params,
        "is_virtual": "virtual" in quals, "is_static": "static" in quals, "is_const": _CONST.search(post) is not None, "is_override": _OVERRIDE.search(post) is not None, "is_final": _FINAL.search(post) is not None, "is_pure_virtual": pure,
        "is_ufunction": "function" in macros, "flags": spec.get("flags", []), "category": spec.get("category"), "is_blueprint_callable": bool(CALLABLE & set(spec.get("flags", []))), "doc": doc, "line": src.line(at + fn.start("name")),
    }
    rec["signature"] = signature(ret, rec["name"], params, rec["is_const"]) + (" = 0" if pure else "")
    out["functions"].append(rec)
    if owner is not None:
        owner["methods"].append(rec["signature"])


def signature(ret: str | None, name: str, params: list[dict], const: bool = False) -> str:
    inner = ", ".join(f"{p['type']} {p['name']}" + (f" = {p['default']}" if p["default"] else "") for p in params)
    return f"{ret + ' ' if ret else ''}{name}({inner}){' const' if const else ''}"


_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")


def callees(body: str) -> list[str]:
    """Distinct identifiers before a bracket, keywords and one-letter names left out, in order."""
    plain = re.sub(r'"(?:\\.|[^"\\\n])*"', '""', strip_comments(body))
    return list(dict.fromkeys(n for n in _CALL.findall(plain) if n not in KEYWORDS and len(n) > 1))


def calls(text: str | None, by_name: bool = False) -> list[tuple[str, str]]:
    """(caller, callee) of all definitions; ``by_name``: of definitions of one name only the last counts."""
    defs = parse(text)["definitions"]
    if by_name:
        defs = list({d["name"]: d for d in defs}.values())
    return [(d["name"], c) for d in defs for c in callees(d["body"])]
