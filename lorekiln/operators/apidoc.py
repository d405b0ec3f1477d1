"""API pages: class signatures and their compact form."""

from __future__ import annotations

import re

from lorekiln.operators.dom import Node, parse, select


def split_top_level(text: str) -> list[str]:
    """Parts between commas that stand in no bracket."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth = max(0, depth + (c in "<([") - (c in ">)]"))
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    tail = text[start:].strip()
    return [p for p in [*out, tail] if p]


def _flat(n: Node | None) -> str:
    return re.sub(r"[\s​]+", " ", n.content()).strip() if n is not None else ""


# Where packages, declarations, methods and marks of deprecation stand, older layouts included, and modifiers.
PACKAGE = ["div.header div.sub-title", "div.header div.subTitle", "div.sub-title", "div.subTitle", "header div.sub-title"]
DECLARATION = [".type-signature", ".typeSignature", "section.class-description pre", "div.class-description pre", "div.description pre"]
METHOD = "section.method-details section.detail, section.method-details li.block-list, section.method-details li.blockList, section.methodDetail, section.methodDetails li.blockList"
MEMBER = ".member-signature, .memberSignature, pre"
DEPRECATED = ".deprecated-label, .deprecatedLabel, .deprecation-block, .deprecated"
MODIFIERS = frozenset("public protected private abstract static final sealed non-sealed default synchronized native strictfp transient volatile".split())

_MARK = re.compile(r"""@(?!interface\b)\w+(?:\((?:"[^"]*"|[^")])*\))?""")
_NAME = r"[A-Za-z_][\w.]*"


def _declared(text: str) -> tuple[list[str], list[str], str]:
    """Annotations, modifiers and the rest of a declaration's head."""
    words = _MARK.sub(" ", text).split()
    return [m.group(0) for m in _MARK.finditer(text)], [w for w in words if w in MODIFIERS], " ".join(w for w in words if w not in MODIFIERS)


def _without_type_variables(text: str) -> str:
    """`<T> Entity` without the variables declared in front."""
    depth = 0
    for i, c in enumerate(text if text.startswith("<") else ""):
        depth += (c == "<") - (c == ">")
        if depth == 0:
            return text[i + 1 :].strip()
    return text


def _package(root: Node) -> str:
    """From the header, else the text of a link to a package summary; '' where there is none."""
    for s in PACKAGE:
        for n in select(root, s):
            text = _flat(n)
            if found := re.search(rf"\bpackage\s+({_NAME})", text, re.I) or re.fullmatch(f"({_NAME})", text):
                return found[1]
    links = [_flat(n) for n in select(root, "a[href]") if n.attrs["href"].endswith("package-summary.html")]
    return next((t for t in links if re.fullmatch(_NAME, t)), "")


def _class(text: str) -> dict | None:
    kind = re.search(r"@interface|\b(?:class|interface|enum|record)\b", text)
    name = re.match(r"\s*([A-Za-z_]\w*)", text[kind.end() :]) if kind else None
    if not name:
        return None
    marks, modifiers, _ = _declared(text[: kind.start()])
    rest = _without_type_variables(text[kind.end() + name.end() :].strip())
    base, _, faces = (x.strip(" ,") for x in re.sub(r"^.*?\bextends\s", "", rest).partition("implements")) if re.search(r"\bextends\s", rest) else ("", "", "")
    if not faces and (m := re.search(r"\bimplements\s+(.+)$", rest)):
        faces = m[1]
    what = "annotation" if kind[0] == "@interface" else kind[0]
    # an interface extends what a class implements
    return {"name": name[1], "kind": what, "modifiers": modifiers, "annotations": marks, "extends": base or None, "implements": split_top_level(faces or (base if what == "interface" else ""))}


def _notes(method: Node) -> tuple[dict[str, str], str | None, list[str]]:
    """Descriptions of parameters and of the result, and the exceptions named, of a method's lists of notes."""
    params: dict[str, str] = {}
    returns, throws = None, []
    for d in select(method, "dl"):
        label = ""
        for n in d.children:
            text = _flat(n) if n.tag in ("dt", "dd") else ""
            if n.tag == "dt":
                label = text.rstrip(":").lower()
            elif text and label:
                named = next((_flat(c) for c in select(n, "code")), "")
                if label.startswith("parameters"):
                    lone = re.match(r"([A-Za-z_]\w*)\s*[-:]\s*(.*)", text)
                    key, said = (named, text.removeprefix(named)) if named else (lone[1], lone[2]) if lone else ("", "")
                    if key:
                        params[key] = said.lstrip(" -:").strip()
                elif label.startswith("returns"):
                    returns = text
                elif label.startswith(("throws", "exception")):
                    key = named or (m[0] if (m := re.match(_NAME, text)) else "")
                    if key and key not in throws:
                        throws.append(key)
    return params, returns, throws


def _parameter(text: str, docs: dict[str, str]) -> dict | None:
    kind, _, name = re.sub(r"\b(?:final|volatile|transient)\s+", "", _MARK.sub("", text)).strip().rpartition(" ")
    return {"name": name, "type": kind.strip(), "description": docs.get(name) or None} if kind.strip() and re.fullmatch(r"[A-Za-z_]\w*", name) else None


def _method(block: Node) -> dict | None:
    sign = next(iter(select(block, MEMBER)), None)
    text = _flat(sign).rstrip(";")
    # annotations may have brackets of their own, so the list of parameters is looked for behind them
    plain = _MARK.sub(lambda m: "\x00" * len(m[0]), text)
    begin, end = plain.find("("), plain.rfind(")")
    if begin < 0 or end < begin:
        return None
    head = re.match(r"(.*?)([A-Za-z_]\w*)\s*$", text[:begin])
    marks, modifiers, result = _declared(head[1]) if head else ([], [], "")
    result = _without_type_variables(result)
    if not result:
        return None
    docs, returns, throws = _notes(block)
    declared = re.search(r"\bthrows\s+(.+)$", text[end + 1 :])
    throws += [t for t in split_top_level(declared[1] if declared else "") if t not in throws]
    params = [p for x in split_top_level(text[begin + 1 : end]) if (p := _parameter(x, docs))]
    return {
        "name": head[2], "return_type": result, "return_description": returns, "parameters": params, "modifiers": modifiers, "annotations": marks, "throws": throws,
        "is_deprecated": "deprecated" in _flat(block).lower(),
    }


def class_signature(html: str) -> dict | None:
    """Package, name, kind, modifiers, extends, implements, annotations, is_deprecated and methods of an API page.

    Null for a page that declares nothing. Of methods with one name, parameter types and result the first counts; a method
    is deprecated when its block says so.
    """
    root = parse(html)
    sign = next((n for s in DECLARATION for n in select(root, s)), None)
    found = _class(_flat(sign)) if sign is not None else None
    if found is None:
        return None
    methods: dict[tuple, dict] = {}
    for block in select(root, METHOD):
        if m := _method(block):
            methods.setdefault((m["name"], tuple(p["type"] for p in m["parameters"]), m["return_type"]), m)
    old = any(a.startswith("@Deprecated") for a in found["annotations"]) or bool(select(root, DEPRECATED))
    return {"package": _package(root), **found, "methods": list(methods.values()), "is_deprecated": old}


SIGNATURE = (
    "package string, name string, kind string, extends string, implements array<string>, modifiers array<string>, annotations array<string>, "
    "methods array<struct<name string, return_type string, return_description string, parameters array<struct<name string, type string, description string>>, "
    "modifiers array<string>, annotations array<string>, throws array<string>, is_deprecated boolean>>, is_deprecated boolean"
)


# The headings and labels of the compact form.
def signature_markdown(s: dict) -> str:
    """A signature in a compact form: declaration, interfaces, and a line a method with its described parts below it."""
    full = f"{s['package']}.{s['name']}" if s["package"] else s["name"]
    words = [*s["annotations"], *s["modifiers"], "@interface" if s["kind"] == "annotation" else s["kind"], s["name"]]
    words += ["extends", s["extends"]] if s["extends"] else []
    words += ["implements", ", ".join(s["implements"])] if s["implements"] else []
    blocks = [f"# {full}", "## Type Definition\n`" + " ".join(words) + "`"]
    if s["implements"]:
        blocks.append("## Implemented Interfaces\n" + "\n".join(f"- `{i}`" for i in s["implements"]))
    lines = ["## Method Signatures"]
    for m in s["methods"]:
        args = ", ".join(f"{p['type']} {p['name']}" for p in m["parameters"])
        lines.append(f"- `{' '.join([*m['annotations'], *m['modifiers'], m['return_type']])} {m['name']}({args})`")
        lines += [f"  - `@param {p['name']}`: {p['description']}" for p in m["parameters"] if p["description"]]
        lines += [f"  - `@return`: {m['return_description']}"] if m["return_description"] else []
        lines += [f"  - `@throws {t}`" for t in m["throws"]]
    return "\n\n".join([*blocks, "\n".join(lines)])


def page_signatures(pages):
    """(url, signature struct) of the pages that hold a class; other and null pages have no row."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(f"url string, signature struct<{SIGNATURE}>")
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"url": u, "signature": s} for u, h in zip(*(c.to_pylist() for c in b.columns)) if h is not None and (s := class_signature(h))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select("url", "html").mapInArrow(run, target)
