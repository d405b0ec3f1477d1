"""Markup residue: which families of markup a text holds, and its clean text with the structure kept.

A text is first cut into code, formulas and running text. Families are looked for in the running text only; code counts by
the marks around it. Cleaning rewrites the running text and leaves code and formulas as they are:
headings become `#` lines, list items `-` or `1.` lines, table rows cells joined by ` | `, code blocks fenced lines, inline
code its bare text, formulas `$...$` or `$$...$$`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.arrow_rows import flat_map

FAMILIES = ("html", "markdown", "wiki", "latex")

# HTML's own elements of more than one letter.
ELEMENTS = """abbr acronym address applet area article aside audio base basefont bdi bdo big blockquote body br button canvas caption
center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input ins kbd label legend li link main map mark menu
meta meter nav noframes noscript object ol optgroup option output param picture pre progress rp rt ruby samp script search section
select slot small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr
track tt ul var video wbr""".split()
#: LaTeX commands that stand before a brace or bracket, and such that stand alone; a choice of this module.
COMMANDS = """begin end section subsection subsubsection paragraph subparagraph chapter part textbf textit texttt textrm textsc textsf
textmd textup textsl emph underline uline cite citep citet citeauthor nocite ref eqref pageref autoref cref nameref label footnote
footnotetext url href caption includegraphics title author date documentclass usepackage newcommand renewcommand bibliography
bibliographystyle input include mbox text hspace vspace frac sqrt mathbf mathrm mathit mathcal mathbb overline hat bar""".split()
BARE = """item maketitle tableofcontents centering hline toprule midrule bottomrule noindent newpage clearpage appendix
bibitem footnotesize smallskip medskip bigskip LaTeX TeX ldots dots""".split()
MATH_ENVIRONMENTS = "equation align gather multline displaymath math eqnarray".split()

_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_TAG = re.compile(rf"""</?(?:{"|".join(ELEMENTS)})(?=[\s/>]){_ATTRS}>|(?:(?<!\w)<|</)[abipqsu](?=[\s/>]){_ATTRS}>""", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

#: Code, by the marks around it; an unclosed fence or environment goes on to the end of the text.
_CODE = re.compile(
    r"""(?=[`~<\\$]|^[ \t\-+*>\d])(?:(?P<fence>^(?P<pad>[ ]{0,3}|[ ]*(?:[-+*>]|\d+[.)])[ ]+)(?P<f>`{3,}|~{3,})(?P<lang>[^`\n]*)\n(?P<fbody>.*?)(?:^[ >]*(?P=f)[`~]*[ \t]*$|\Z))
      |(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(?P<vbody>.*?)(?:\\end\{(?P=env)\}|\Z))
      |(?P<verbshort>\\verb\*?(?P<d>[|!+=/@])(?P<sbody>[^\n]*?)(?P=d))
      |(?P<wiki><(?P<wt>syntaxhighlight|source|nowiki)\b[^<>]*(?<!/)>(?P<wbody>.*?)(?:</(?P=wt)>|\Z))
      |(?P<pre><pre\b[^<>]*>(?P<pbody>.*?)(?:</pre\s*>|\Z))
      |(?P<html><code\b[^<>]*>(?P<cbody>.*?)</code\s*>)
      |(?P<drop><(?P<dt>script|style)\b[^<>]*>.*?(?:</(?P=dt)\s*>|\Z))
      |(?P<ticks>(?<![`\\])(?P<t>`{1,2})(?!`)(?P<tbody>[^`\n]+?(?:\n(?!\s*\n)[^`\n]+?)?)(?P=t)(?!`))
      |(?P<indent>(?:(?<=\n\n)|\A)(?:(?:[ ]{4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?=[ ]{4}|\t))*)+)
      |(?P<shell>^\$[ ]+\S[^\n]*$))""",
    re.S | re.M | re.X | re.I,
)
_MAYBE_CODE = re.compile(r"[`~]|<(?:pre|code|script|style|source|syntaxhighlight|nowiki)\b|\\(?:begin|verb)|^(?: {4}|\t|\$ )", re.M | re.I)
_FORMULA = re.compile(
    r"""(?=[$\\])(?:(?P<env>\\begin\{(?P<e>(?:"""
    + "|".join(MATH_ENVIRONMENTS)
    + r""")\*?)\}(?P<ebody>.*?)(?:\\end\{(?P=e)\}|\Z))
      |(?P<dd>(?<![\\$])\$\$(?P<ddbody>[^$]+)\$\$(?!\$))
      |(?P<br>(?<!\\)\\\[(?P<brbody>.+?)(?<!\\)\\\])
      |(?P<pa>(?<!\\)\\\((?P<pabody>.+?)(?<!\\)\\\))
      |(?P<d>(?<![\\$\w])\$(?![\s{$\d.,])(?P<dbody>[^$\n]*?(?:\\[A-Za-z]|\^|_[{A-Za-z0-9]|[=<>+*/])[^$\n]*?|[A-Za-z]'?)(?<!\s)\$(?![\w$]))
      |(?P<n>(?<![\\$\w])\$(?=[\d.])(?P<nbody>[^$\n]*?(?:\\[A-Za-z]|\^|_\{)[^$\n]*?)(?<!\s)\$(?![\w$])))""",
    re.S | re.X,
)

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", re.M)
_UNDERLINE = re.compile(r"^ {0,3}(={3,}|-{3,})[ \t]*$", re.M)
_NO_TITLE = re.compile(r"[ \t]*(?:[-+*>#|=]|\d+[.)])(?:[ \t|=]|$)|[ \t]*$")
_STRONG = re.compile(r"(?<![\\*\w])(\*{1,3})(?=[^\s*.])([^*\n]+?)(?<=[^\s*])\1(?!\*|\w)")
_BOLD_INSIDE = re.compile(r"(?<![\\*])\*\*(?=[^\s*.])([^*\n]+?)(?<=[^\s*])\*\*(?!\*)")
_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])(?![A-Z]+__|[a-z0-9_]+__)([^\n]+?)(?<=[^\s_])\1(?!\w)")
_STRUCK = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)")
_LINK = re.compile(r"(!?)(?<!\w)\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*<?[^\s()<>]*(?:\([^\s()]*\))?[^\s()<>]*>?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
_REF_LINK = re.compile(r"(!?)(?<![\w\])])\[([^\[\]\n^]+)\]\[([^\[\]\n]*)\]")
_DEFINITION = re.compile(r"^ {0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]*\S+[^\n]*(?:\n|\Z)", re.M)
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\](:[ \t]*)?")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
_ITEM = re.compile(r"^([ \t]*)([-+*]|\d{1,9}[.)])[ \t]+(?=\S)(\[[ xX]\][ \t]+)?", re.M)
_QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(?=\S)", re.M)
_RULE_ROW = re.compile(r"^[ \t]*(?:\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?|\|[ \t]*:?-+:?[ \t]*\|)[ \t]*$", re.M)

_W_HEADING = re.compile(r"^(?:(={2,6})(?!=)[ \t]*([^=\n][^\n]*?)[ \t]*\1|=[ \t]+([^=\n]*[^\W\d][^=\n]*?)[ \t]+=)[ \t]*$", re.M)
_W_STRONG = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])([^\n]+?)(?<=[^'\s])\1(?!')")
_W_LINK = re.compile(r"(?<![\w\[])\[\[(?=[^\s\[\]])([^\[\]\n]+)\]\](?!\])")
_W_URL = re.compile(r"(?<![\w\]!])\[((?:https?|ftp)://[^\s\[\]]+)(?:[ \t]+([^\[\]\n]*))?\](?![(\[])")
_W_CALL = re.compile(r"(?<!\{)\{\{(?=[A-Z#:]|[^\s{}|]+\|)([^{}\n]+)\}\}(?!\})")
_W_TABLE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[^\n|]*)[ \t]*$", re.M)
_W_SWITCH = re.compile(r"__[A-Z]{3,}__")
_W_TAG = re.compile(r"</?(?:ref|references|gallery|syntaxhighlight|nowiki)\b[^<>]*>")

_L_COMMAND = re.compile(r"\\(" + "|".join(COMMANDS) + r")\*?[ \t]*(?=[{\[])")
_L_BARE = re.compile(r"(?<![\w\\:/])\\(?:" + "|".join(BARE) + r")(?![A-Za-z])")


def _pieces(text: str) -> list[tuple[str, str, str]]:
    """(kind, mark, body): kind is text, block, inline, formula, display or drop; mark the family that marked it, or ''."""
    found: list[tuple[int, int, str, str, str]] = []
    if _MAYBE_CODE.search(text):
        for m in _CODE.finditer(text):
            g = m.group
            if g("fence") is not None:
                item = ("block", "markdown", g("fbody"))
            elif g("verb") is not None:
                item = ("block", "latex", g("vbody"))
            elif g("verbshort") is not None:
                item = ("inline", "latex", g("sbody"))
            elif g("wiki") is not None:
                item = ("block" if "\n" in g("wbody") else "inline", "wiki", g("wbody"))
            elif g("pre") is not None:
                item = ("block", "html", html.unescape(_TAG.sub("", g("pbody"))))
            elif g("html") is not None:
                item = ("inline", "html", html.unescape(_TAG.sub("", g("cbody"))))
            elif g("drop") is not None:
                item = ("drop", "html", "")
            elif g("ticks") is not None:
                item = ("inline", "markdown", g("tbody"))
            elif g("indent") is not None:
                item = ("block", "", re.sub(r"(?m)^(?: {4}|\t)", "", g("indent")))
            else:
                item = ("block", "", g("shell"))
            found.append((m.start(), m.end(), *item))
    out: list[tuple[str, str, str]] = []
    at = 0
    for a, b, kind, mark, body in [*found, (len(text), len(text), "", "", "")]:
        if a > at:
            out += _formulas(text[at:a])
        if kind:
            out.append((kind, mark, body))
        at = b
    return out


def _formulas(text: str) -> list[tuple[str, str, str]]:
    if "$" not in text and "\\" not in text:
        return [("text", "", text)]
    out: list[tuple[str, str, str]] = []
    at = 0
    for m in _FORMULA.finditer(text):
        if m.start() > at:
            out.append(("text", "", text[at : m.start()]))
        shown = m.group("ebody") or m.group("ddbody") or m.group("brbody")
        if shown is not None:
            out.append(("display", "latex", shown))
        else:
            out.append(("formula", "latex", m.group("pabody") or m.group("dbody") or m.group("nbody") or ""))
        at = m.end()
    if at < len(text):
        out.append(("text", "", text[at:]))
    return out


def _underlined(t: str) -> Iterator[tuple[int, int, int, str]]:
    """(start and end of the title, end of the rule, its character) of each heading underlined by a rule."""
    for m in _UNDERLINE.finditer(t):
        end = m.start() - 1
        start = t.rfind("\n", 0, max(0, end)) + 1
        if end > start and not _NO_TITLE.match(t[start:end]):
            yield start, end, m.end(), m.group(1)[0]


def _set_headings(t: str) -> str:
    out, at = [], 0
    for start, end, after, rule in _underlined(t):
        if start >= at:
            out += [t[at:start], "# " if rule == "=" else "## ", t[start:end]]
            at = after
    return "".join([*out, t[at:]])


def _has_html(t: str) -> bool:
    if "<" in t and (_TAG.search(t) or "<!--" in t):
        return True
    return "&" in t and any(m.group(0)[1] == "#" or m.group(0)[1:] in html5 for m in _REFERENCE.finditer(t))


def _has_markdown(t: str) -> bool:
    return bool(
        _ITEM.search(t)
        or ("#" in t and _HEADING.search(t))
        or ("*" in t and (_STRONG.search(t) or _BOLD_INSIDE.search(t)))
        or ("_" in t and _UNDER.search(t))
        or ("~~" in t and _STRUCK.search(t))
        or ("[" in t and (_LINK.search(t) or _REF_LINK.search(t) or _DEFINITION.search(t) or _FOOTNOTE.search(t)))
        or ("<" in t and _AUTOLINK.search(t))
        or (">" in t and _QUOTE.search(t))
        or ("|" in t and _RULE_ROW.search(t))
        or (("---" in t or "===" in t) and next(_underlined(t), None))
    )


def _has_wiki(t: str) -> bool:
    return bool(
        ("=" in t and _W_HEADING.search(t))
        or ("''" in t and _W_STRONG.search(t))
        or ("[[" in t and _W_LINK.search(t))
        or ("://" in t and "[" in t and _W_URL.search(t))
        or ("{{" in t and _W_CALL.search(t))
        or (("{|" in t or "|}" in t or "|-" in t) and any("{|" in m.group(0) or "|}" in m.group(0) or re.fullmatch(r"\s*\|-+\s*", m.group(0)) for m in _W_TABLE.finditer(t)))
        or ("__" in t and _W_SWITCH.search(t))
        or ("<" in t and _W_TAG.search(t))
    )


def _has_latex(t: str) -> bool:
    return "\\" in t and bool(_L_COMMAND.search(t) or _L_BARE.search(t))


_DETECT = {"html": _has_html, "markdown": _has_markdown, "wiki": _has_wiki, "latex": _has_latex}


def families_of(pieces: list[tuple[str, str, str]]) -> list[str]:
    """The families marked anywhere outside code, in the order of FAMILIES."""
    marks = {mark for _, mark, _ in pieces}
    # code and formulas leave a letter behind, so that what stands around them is judged as it stands in the text
    running = "".join(body if kind == "text" else {"block": "\n", "drop": ""}.get(kind, "x") for kind, _, body in pieces)
    return [f for f in FAMILIES if f in marks or _DETECT[f](running)]


def _tag_text(m: re.Match) -> str:
    tag = m.group(0)
    name = re.match(r"</?([A-Za-z0-9]+)", tag).group(1).lower()
    shut = tag[1] == "/"
    if name == "br":
        return "\n"
    if name == "li":
        return "" if shut else "\n- "
    if name in ("td", "th"):
        return " | " if shut else ""
    if name == "dd":
        return "" if shut else ": "
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return "\n" if shut else "\n" + "#" * int(name[1]) + " "
    if name == "img":
        alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag, re.I)
        return next((x for x in alt.groups() if x), "") if alt else ""
    if name in ("p", "div", "ul", "ol", "table", "tr", "dl", "dt", "section", "article", "blockquote", "hr", "thead", "tbody", "figure", "header", "footer", "main"):
        return "\n"
    return ""


def _wiki_link(m: re.Match) -> str:
    target, *rest = m.group(1).split("|")
    kind = target.split(":", 1)[0].strip().lower()
    if kind == "category":
        return ""
    if kind in ("file", "image"):
        return rest[-1] if rest else ""
    return rest[-1] if rest else target


_L_TABLE = re.compile(r"\\begin\{(tabular[x*]?|tabularx|array|longtable)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_L_POINTER = re.compile(r"\\(?:cite[a-z]*|nocite|ref|eqref|pageref|autoref|cref|nameref)\*?[ \t]*(?:\[[^\]\n]*\])*\{([^{}\n]*)\}")
_L_SETTING = re.compile(r"\\(?:label|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|vspace|hspace)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_L_HREF = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_L_FRAME = re.compile(r"[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_L_ITEM = re.compile(r"(?m)^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*")
_L_WRAPPED = re.compile(r"\\(footnote)\{([^{}]*)\}|\\(?:" + "|".join(COMMANDS) + r")\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_L_LEVELS = (("chapter", 1), ("section", 1), ("subsection", 2), ("subsubsection", 3), ("paragraph", 4))
_L_HEADINGS = [(re.compile(r"\\" + name + r"\*?\{([^{}\n]*)\}"), "\n" + "#" * level + r" \1" + "\n") for name, level in _L_LEVELS]


def _until_still(pattern: re.Pattern, to, t: str) -> str:
    """Replace until nothing changes: marks nested to any depth are all undone. Each round takes at least two characters."""
    n = 1
    while n:
        t, n = pattern.subn(to, t)
    return t


def _latex_text(t: str) -> str:
    """Headings, items and cells from commands; a reference or citation leaves its key in brackets, a setting nothing.

    An ampersand parts cells inside tables only, and a tilde is a blank only between two words or before a command.
    """
    for pattern, to in _L_HEADINGS:
        t = pattern.sub(to, t)
    t = _L_POINTER.sub(r"[\1]", _L_SETTING.sub("", t))
    t = _L_TABLE.sub(lambda m: re.sub(r"[ \t]*(?<!\\)&[ \t]*", " | ", m.group(0)), t)
    t = _L_FRAME.sub("", _L_HREF.sub(r"\1", t))
    t = _L_ITEM.sub(lambda m: "- " + (m.group(1) + ": " if m.group(1) else ""), t)
    t = _until_still(_L_WRAPPED, lambda m: f" ({m.group(2)})" if m.group(1) else m.group(3), t)
    t = re.sub(r"(?m)[ \t]*\\\\[ \t]*$", "", t)
    t = _L_BARE.sub("", t)
    return re.sub(r"(?<=[\w.,;:)])~(?=[\w\\(\[$])", " ", t) if "~" in t else t


def _wiki_call(m: re.Match) -> str:
    """A template call: of one that carries sentences its name and these, of any other nothing."""
    name, *given = m.group(1).split("|")
    texts = [v.split("=", 1)[-1].strip() for v in given]
    said = [v for v in texts if len(v.split()) > 1]
    return name.strip().lstrip("#:") + ": " + " ".join(said) if said else ""


def _clean_text(t: str, families: list[str]) -> str:
    if "latex" in families and "\\" in t:
        t = _latex_text(t)
    if "wiki" in families:
        if "=" in t:
            t = _W_HEADING.sub(lambda m: "#" * max(1, len(m.group(1) or "") - 1) + " " + (m.group(2) or m.group(3)), t)
        if "[[" in t:
            t = _W_LINK.sub(_wiki_link, t)
        if "://" in t and "[" in t:
            t = _W_URL.sub(lambda m: m.group(2) or m.group(1), t)
        if "{{" in t:
            t = _until_still(_W_CALL, _wiki_call, t)
        if "{|" in t:
            t = re.sub(r"(?m)^\|(?![-}|])[ \t]*([^\n]*)$", lambda m: re.sub(r"[ \t]*\|\|[ \t]*", " | ", m.group(1)), t)
            t = re.sub(r"(?m)^![ \t]*([^\n]*)$", lambda m: re.sub(r"[ \t]*!![ \t]*", " | ", m.group(1)), t)
        if "|" in t:
            t = _W_TABLE.sub("", t)
        if "__" in t or "<" in t:
            t = _W_SWITCH.sub("", _W_TAG.sub("", t))
        if "''" in t:
            t = _until_still(_W_STRONG, r"\2", t)
    if "markdown" in families:
        if "---" in t or "===" in t:
            t = _set_headings(t)
        if "#" in t:
            t = _HEADING.sub(r"\1 \2", t)
        if "[" in t:
            t = _DEFINITION.sub("", t)
            t = _REF_LINK.sub(r"\2", _LINK.sub(r"\2", t) if "](" in t else t)
            t = _FOOTNOTE.sub("", t)
        if "<" in t:
            t = _AUTOLINK.sub(r"\1", t)
        if "|" in t and _RULE_ROW.search(t):
            t = re.sub(r"(?m)^\x00\n?", "", _RULE_ROW.sub("\x00", t))
            t = re.sub(r"(?m)^[ \t]*\|[ \t]*(\S[^\n]*?)[ \t]*\|[ \t]*$", r"\1", t)
        if ">" in t:
            t = _QUOTE.sub("", t)
        t = _ITEM.sub(lambda m: m.group(1) + ("-" if m.group(2) in "-+*" else m.group(2)) + " ", t)
        if "*" in t:
            t = _until_still(_BOLD_INSIDE, r"\1", _until_still(_STRONG, r"\2", t))
        if "_" in t:
            t = _until_still(_UNDER, r"\2", t)
        if "~~" in t:
            t = _STRUCK.sub(r"\1", t)
    if "html" in families:
        if "<" in t:
            t = _TAG.sub(_tag_text, _COMMENT.sub("", t)).replace(" | \n", "\n")
        if "&" in t:
            t = _REFERENCE.sub(lambda m: html.unescape(m.group(0)), t)
    return t


_COPIED = re.compile(r"(?m)^[ \t]*Copied!?[ \t]*$\n?")


def clean_markup(text: str) -> tuple[str, bool, list[str]]:
    """Clean text, whether it holds code, and its families of markup. Line ends become \\n, copy-button residue goes."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    pieces = _pieces(text)
    families = families_of(pieces)
    out: list[str] = []
    code = False
    for kind, _, body in pieces:
        if kind == "text":
            out.append(_clean_text(body, families))
        elif kind == "block":
            code = True
            out.append("\n```\n" + body.strip("\n") + "\n```\n")
        elif kind == "inline":
            code = True
            out.append(body)
        elif kind == "display":
            out.append("\n$$ " + body.strip() + " $$\n")
        elif kind == "formula":
            out.append("$" + body.strip() + "$")
    joined = "".join(out)
    if "Copied" in joined:
        joined = _COPIED.sub("", joined)
    if " \n" in joined or "\t\n" in joined:
        joined = "\n".join([line.rstrip(" \t") for line in joined.split("\n")])
    while "\n\n\n" in joined:
        joined = joined.replace("\n\n\n", "\n\n")
    return joined.strip("\n").rstrip(" \t"), code, families


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, clean, has_code, markup) of each row: clean text, code flag and families of its content.

    A narrow pass without a shuffle. A null content gives null, false and no family; an empty one stays empty. The given
    has_code, which may be null or wrong, is not used. Repeated rows give repeated rows.
    """

    def make():
        def f(chunk_id, content):
            if content is None:
                return [(chunk_id, None, False, [])]
            return [(chunk_id, *clean_markup(content))]

        return f

    return flat_map(chunks.select("chunk_id", "content"), make, "chunk_id string, clean string, has_code boolean, markup array<string>")


def marked_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, markup): one row per chunk and family of markup its content holds outside code."""
    return clean_chunks(chunks).select("chunk_id", F.explode("markup").alias("markup")).distinct()
