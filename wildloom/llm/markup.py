"""Texts with HTML, Markdown, wiki or LaTeX markup to clean text.

HTML is taken apart into containers. Each container path (all open tags but
inline ones, with classes, digits generalised) gets a score in every page: its
plain text counts for it, its links and what several pages of the host repeat
count against it. The scores of all pages of a host are
summed in Spark; a path with enough pages wins or loses on that host, and the
pages are extracted again from the winning paths. A page that has no winning
path is kept whole, and so are pages without a host. Hidden tags are left out
on every page. Headings, lists, code, quotes, tables and formulas keep a plain
form. Which kinds of markup a text holds is told from the whole text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.operators.skew import lookup_join
from wildloom.session import c, columns_or_fail

KINDS = ("html", "markdown", "wiki", "latex")
#: Text in the same container of so many different pages of a host is repeated, and counts against the container as a link does.
REPEATED_PAGES = 3
#: A container path can only lose on a host if so many different pages have it.
VOTERS = 3


# The HTML tags that count as markup.
TAGS = frozenset(
    """a abbr address article aside b big blink blockquote body br button caption center cite code dd del details dfn div dl dt em embed fieldset figcaption figure font footer form
frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol optgroup option p picture pre q s samp script section select
small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr""".split()
)
_VOID = frozenset("br hr img input link meta source wbr embed".split())
_HIDDEN = frozenset("script style template noscript head iframe svg".split())
_BLOCK = frozenset("p div section article main header footer aside nav form table ul ol dl blockquote figure center body html td th dd dt fieldset address".split())
_INLINE = frozenset("a abbr b big blink cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_NAMES = frozenset(k[:-1] for k in html5 if k.endswith(";"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<!\[CDATA\[|<(/?)([A-Za-z][A-Za-z0-9]{0,11})((?:\s[^<>]*)?)/?>", re.S | re.I)
_CLASS = re.compile(r"class\s*=\s*[\"']?([^\"'>]*)", re.I)
_ALT = re.compile(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_REF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_CUT = re.compile(r"<(?:/(?:[A-Za-z][A-Za-z0-9]{0,11})\s*\Z|(?:p|div|span|a|img|td|tr|table|font|pre|ul|ol|li|script|style|form|iframe)\s+(?:class|style|href|src|id|rel|alt|width|align|color|name|target)\s*=)", re.I)


def _known_ref(m: re.Match) -> bool:
    return m.group(1) is None or m.group(1) in _NAMES


def is_html(t: str) -> bool:
    """Tags whole or broken, comments and character references; not comparisons or type parameters."""
    if "&" in t and any(map(_known_ref, _REF.finditer(t))):
        return True
    if "<" not in t:
        return False
    for m in _TAG.finditer(t):
        name = m.group(2)
        if name is None or (name.lower() in TAGS and (m.group(1) or len(name) > 1 or name in "pP" or not m.start() or not (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_:"))):
            return True
    return bool(_CUT.search(t)) or "<!--" in t


_MD_LINES = re.compile(
    r"^ {0,3}\*?#{1,6}\*? +\S|^ {0,3}[-*+] +\S|^ {0,3}>+ ?\S|^ {0,3}(?:```|~~~)|^[^\n|]*\S[^\n]*\n {0,3}(?:={3,}|-{3,}) *$|^ {0,3}\[[^\]\n]+\]: +\S+|^ *\|?.*\| *:?-{2,}:? *(?:\||$)|^ *\|? *:?-{2,}:? *\||^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$",
    re.M,
)
_MD_ORDERED = re.compile(r"^ {0,3}\d{1,3}[.)] +\S", re.M)
_MD_INLINE = re.compile(
    r"!?\[[^\]\n]+\]\([^)\s]+(?:\s\"[^\"\n]*\")?\)|!\[[^\]\n]*\]\[|\[[^\[\]\n]{2,}\] ?\[[^\[\]\n]{0,40}\](?!\])|(?<![`\\\w])(`{1,2})(?!`)[^`\n]+(?<!`)\1(?![`\w])"
    r"|(?<![\w*\\/])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])|(?<![\w_\\/])__(?=[^\s_])[^\n_]*[^\s_]__(?![\w_])|(?<![\w*\\/.%-])\*(?=[^\W_])(?:[^*\n]*[\w.,;:!?)'’])\*(?![\w*/.-])"
    r"|(?<![\w*])\*\*\*(?=\w)[^*\n]+\*\*\*(?![\w*])|(?<![\w_\\/%.-])_(?=[^\W\d_])[^_\n]+[\w.,;:!?]_(?![\w_%/.-])|(?<![~\w])~~(?=\S)[^~\n]+~~(?!~)|<https?://[^\s>]+>"
)
# Names between double underscores that are no strong words but parts of a well-known language.
_DUNDER = re.compile(r"__(?:init|main|name|file|dict|str|repr|call|class|doc|all|new|del|len|iter|next|enter|exit|eq|ne|lt|gt|le|ge|hash|bool|add|sub|mul|contains|getitem|setitem|delitem|getattr|setattr|slots|module|version|author|path|builtins|import|future|annotations|await|aiter|anext)__")
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|(?<![\w'])'{2,5}(?=[^\s'])[^'\n]+'{2,5}(?![\w'])|^={2,6} ?[^=\n]+?={2,6} *$|^\{\|[^\n]*$|^\|-(?!-)[^\n|]*$|^\|\} *$|\[(?:https?|ftp)://\S+ [^\]\n]+\]|<nowiki|<ref[ >/]|__(?:NO)?TOC__|^#REDIRECT",
    re.M,
)
# LaTeX commands and environments that count as markup even without an argument.
_COMMANDS = """section subsection subsubsection chapter paragraph subparagraph textbf textit texttt textsc emph underline item begin end cite citep citet ref eqref label footnote frac dfrac sqrt leq geq neq approx equiv
alpha beta gamma delta epsilon lambda theta sigma omega pi mu phi psi sum prod int cdot times infty partial nabla mathbb mathbf mathrm mathcal left right ldots dots quad hline usepackage documentclass title author maketitle
verb href url caption includegraphics centering noindent par newline bibitem hspace vspace text rightarrow leftarrow to in forall exists subset cup cap log lim""".split()
_LATEX = re.compile(r"(?<![\w:\\])\\(?:" + "|".join(sorted(_COMMANDS, key=len, reverse=True)) + r")(?![A-Za-z\\])|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^\n]*?\}|\\\[[^\n]+?\\\]|\\\([^\n()]+?\\\)|\$\$[^$]+\$\$")
_MATH = re.compile(r"(?<![\w\\$])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\])\$(?![\w$])")
_MATHY = re.compile(r"[\\^_={}<>]|\b[A-Za-z]\s?\([^)]*\)|^[A-Za-z]$|[A-Za-z]\s?[+\-*/]\s?\w")


def _is_math(m: re.Match) -> bool:
    return bool(_MATHY.search(m.group(1)))


def is_markdown(t: str) -> bool:
    if _MD_LINES.search(t):
        return True
    if ("1" in t or "2" in t) and len(_MD_ORDERED.findall(t)) > 1:
        return True
    return any(not _DUNDER.fullmatch(m.group()) for m in _MD_INLINE.finditer(t))


def is_latex(t: str) -> bool:
    return ("\\" in t and bool(_LATEX.search(t))) or ("$" in t and ("$$" in t and bool(_LATEX.search(t)) or any(map(_is_math, _MATH.finditer(t)))))


_SIGNS = re.compile(r"[#*_`~\[\]|>{}+=]|^ {0,3}[-+\d]", re.M)


def kinds_of(text: str | None) -> list[str]:
    """The markup kinds in a text; null, empty and plain texts have none."""
    if not text:
        return []
    out = []
    if ("<" in text or "&" in text) and is_html(text):
        out.append("html")
    plain = html.unescape(re.sub(r"<(?:script|style)\b.*?</(?:script|style)>", "", text, flags=re.S | re.I)) if out else text
    if out and "<" in plain:
        plain = _TAG.sub(lambda m: " " if (m.group(2) or "").lower() in TAGS or m.group(2) is None else m.group(), re.sub(r"<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", " ", plain, flags=re.S | re.I))
    if _SIGNS.search(plain) and is_markdown(plain):
        out.append("markdown")
    if ("[[" in plain or "{{" in plain or "''" in plain or "==" in plain or "{|" in plain or "|-" in plain or "[http" in plain or "__" in plain) and _WIKI.search(plain):
        out.append("wiki")
    if ("\\" in plain or "$" in plain) and is_latex(plain):
        out.append("latex")
    return out


# --- HTML ------------------------------------------------------------------------------------------


def _step(tag: str, attrs: str) -> str:
    m = _CLASS.search(attrs) if attrs else None
    return f"{tag}.{re.sub(r'[0-9]+', '#', m.group(1).strip().lower())}" if m and m.group(1).strip() else tag


def walk_html(t: str) -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    """(event, tag or text, container path, open tags): event is open, close or text; only text has a path."""
    stack: list[tuple[str, str]] = []
    at = 0

    def here() -> str:
        return ">".join(s for x, s in stack if x not in _INLINE) or "body"

    for m in _TAG.finditer(t):
        name = (m.group(2) or "").lower()
        if m.group(2) is not None and name not in TAGS:
            continue
        if stack and stack[-1][0] in ("script", "style") and not (m.group(1) and name == stack[-1][0]):
            continue
        if m.start() > at:
            yield "text", t[at : m.start()], here(), tuple(x for x, _ in stack)
        at = m.end()
        if m.group(2) is None:
            continue
        if m.group(1):
            if any(x == name for x, _ in stack):
                while stack:
                    top, _ = stack.pop()
                    yield "close", top, "", tuple(x for x, _ in stack)
                    if top == name:
                        break
            continue
        if name in ("p", "li", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
            yield "close", name, "", tuple(x for x, _ in stack)
        if name not in _VOID:
            stack.append((name, _step(name, m.group(3))))
        yield "open", name + " " + (m.group(3) or ""), "", tuple(x for x, _ in stack)
    if at < len(t):
        yield "text", t[at:], here(), tuple(x for x, _ in stack)
    while stack:
        top, _ = stack.pop()
        yield "close", top, "", tuple(x for x, _ in stack)


def path_pieces(t: str) -> Iterator[tuple[str, str, bool]]:
    """(container path, text, whether it is a link) of the visible pieces of a page."""
    for event, s, path, open_tags in walk_html(t):
        if event == "text" and _HIDDEN.isdisjoint(open_tags) and (piece := " ".join(s.split())):
            yield path, piece, "a" in open_tags


def path_scores(t: str) -> dict[str, int]:
    """Score of each container path of a page by itself: signs of plain text less those of links."""
    out: dict[str, int] = {}
    for path, piece, link in path_pieces(t):
        out[path] = out.get(path, 0) + (-len(piece) if link else len(piece))
    return out


_ITEM = re.compile(r"\n(?:-|[0-9]+\.) ")


def html_to_text(t: str, lost: frozenset[str] = frozenset()) -> str:
    """Plain structure of a page, without hidden tags and the containers whose path is in ``lost``; a page with no other containers is kept whole."""
    if lost and all(path in lost for path, _, _ in path_pieces(t)):
        lost = frozenset()
    out: list[str] = []
    order: list[int] = []
    for event, s, path, open_tags in walk_html(t):
        if event == "text":
            if not _HIDDEN.isdisjoint(open_tags):
                continue
            if path in lost:
                # the mark of a list item goes with its text
                k = len(out) - 1
                while k >= 0 and not out[k].strip():
                    k -= 1
                if k >= 0 and s.strip() and _ITEM.fullmatch(out[k]):
                    del out[k]
                continue
            s = html.unescape(s)
            if "pre" not in open_tags:
                s = re.sub(r"[ \t\r\f]+", " ", s)
            s = re.sub(r"<(?:/[a-zA-Z]{1,10}\s*\Z|[bius](?=[A-Z]))", "", s)
            out.append(s)
            continue
        name, _, attrs = s.partition(" ")
        if event == "open":
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("\n\n" + "#" * int(name[1]) + " ")
            elif name in ("ul", "ol"):
                order.append(0 if name == "ol" else -1)
                out.append("\n")
            elif name == "li":
                if order and order[-1] >= 0:
                    order[-1] += 1
                    out.append(f"\n{order[-1]}. ")
                else:
                    out.append("\n- ")
            elif name == "pre":
                out.append("\n```\n")
            elif name == "code" and "pre" not in open_tags:
                out.append("`")
            elif name == "blockquote":
                out.append("\n\n> ")
            elif name == "tr":
                out.append("\n")
            elif name == "br":
                out.append("\n")
            elif name == "hr":
                out.append("\n\n")
            elif name == "img":
                m = _ALT.search(attrs)
                out.append(next((html.unescape(g) for g in m.groups() if g), "") if m else "")
            elif name in ("td", "th"):
                out.append(" | ")
            elif name in _BLOCK:
                out.append("\n\n")
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6") or (name in _BLOCK and name not in ("td", "th")):
            if name in ("ul", "ol") and order:
                order.pop()
            out.append("\n\n")
        elif name == "pre":
            out.append("\n```\n")
        elif name == "code" and "pre" not in open_tags:
            out.append("`")
    return re.sub(r"\n +\| ", "\n", "".join(out))


# --- Markdown, wiki and LaTeX ------------------------------------------------------------------------

_KEEP = re.compile(r"^```.*?^```[^\n]*$|^~~~.*?^~~~[^\n]*$|(?<![`\w])`[^`\n]+`(?![`\w])|\\begin\{(verbatim|lstlisting|minted)\}.*?\\end\{\1\}|\$\$.+?\$\$|\\\[.+?\\\]|\\begin\{(equation|align|gather)(\*?)\}.*?\\end\{\2\3\}", re.S | re.M)


def _plain_piece(s: str) -> str:
    if s.startswith(("```", "~~~")):
        body = s.split("\n", 1)[1] if "\n" in s else ""
        return "```\n" + re.sub(r"\n?(?:```|~~~)[^\n]*\Z", "", body) + "\n```"
    if s.startswith("`"):
        return s
    if s.startswith("\\begin{verb") or s.startswith("\\begin{lst") or s.startswith("\\begin{mint"):
        return "```\n" + re.sub(r"\\(?:begin|end)\{\w+\}(?:\[[^\]]*\]|\{\w+\})?", "", s).strip("\n") + "\n```"
    inner = re.sub(r"\\(?:begin|end)\{\w+\*?\}|\\label\{[^}]*\}|\A\$\$|\$\$\Z|\A\\\[|\\\]\Z", "", s)
    return f"$${inner.strip()}$$"


_LIGHT = (
    (re.compile(r"^ {0,3}\[[^\]\n]+\]: +\S+.*$", re.M), ""),
    (re.compile(r"!\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])"), r"\1"),
    (re.compile(r"\[\[(?:Category|File|Image):[^\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}\n]*\}\}"), ""),
    (re.compile(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]"), r"\1"),
    (re.compile(r"\[([^\]\n]+)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]{2,})\] ?\[[^\[\]\n]{0,40}\]"), r"\1"),
    (re.compile(r"<(https?://[^\s>]+)>"), r"\1"),
    (re.compile(r"^ {0,3}(?!\s)([^\n#>|*+`~=-][^\n]*)\n {0,3}={3,} *$", re.M), r"# \1"),
    (re.compile(r"^ {0,3}(?!\s)([^\n#>|*+`~=-][^\n]*)\n {0,3}-{3,} *$", re.M), r"## \1"),
    (re.compile(r"^(={2,6}) ?([^=\n]+?) ?={2,6} *$", re.M), lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
    (re.compile(r"^ {0,3}(#{1,6}) +(.*?) *#* *$", re.M), r"\1 \2"),
    (re.compile(r"^ {0,3}[*+-] +(?=\S)", re.M), "- "),
    (re.compile(r"^\{\|[^\n]*$|^\|\} *$|^\|-[^\n]*$|^ *\|?(?: *:?-{2,}:? *\|)+ *:?-*:? *$", re.M), ""),
    (re.compile(r"^[|!] *([^|\n]*?) *(?:\|\||!!) *(.*)$", re.M), r"\1 | \2"),
    (re.compile(r"^ *\| *(.*?) *\| *$", re.M), r"\1"),
    (re.compile(r"(?<![\w'])'{2,5}(?=[^\s'])([^'\n]+)'{2,5}(?![\w'])"), r"\1"),
    (re.compile(r"(?<![\w*\\/])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])"), r"\2"),
    (re.compile(r"(?<![\w_\\/])(_{1,2})(?=[^\W\d_])([^_\n]*[^\s_])\1(?![\w_])"), r"\2"),
    (re.compile(r"~~(?=\S)([^~\n]+)~~"), r"\1"),
)
_TEX = (
    (re.compile(r"\\(section|subsection|subsubsection|chapter|paragraph)\*?\{([^}\n]*)\}"), lambda m: "\n" + {"chapter": "#", "section": "#", "subsection": "##"}.get(m.group(1), "###") + " " + m.group(2) + "\n"),
    (re.compile(r"\\begin\{(?:itemize|enumerate|description|quote|center|document|abstract|table|tabular|figure)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})?|\\end\{[a-z]+\*?\}"), ""),
    (re.compile(r"[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*"), "- "),
    (re.compile(r"~?\\(?:cite[pt]?|ref|eqref|label|bibitem|vspace|hspace|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^}\n]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|texttt|textsc|emph|underline|footnote|text|mathrm|title|author|caption)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\href\{[^}\n]*\}\{([^}\n]*)\}"), r"\1"),
    (re.compile(r"\\(?:maketitle|centering|noindent|newline|hline|par)(?![A-Za-z])|\\\\(?=\s|$)"), ""),
)


def light_to_text(t: str, kinds: list[str]) -> str:
    """Markdown, wiki and LaTeX marks to plain structure; code and formulas are set aside first."""
    kept: list[str] = []
    # two private-use signs that the text itself does not have
    free = (x for x in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE))) if x not in t)
    begin, end = next(free), next(free)

    def keep(s: str) -> str:
        kept.append(s)
        return f"{begin}{len(kept) - 1}{end}"

    t = _KEEP.sub(lambda m: keep(_plain_piece(m.group())), t)
    if "latex" in kinds:
        t = _MATH.sub(lambda m: keep(m.group()) if _is_math(m) else m.group(), t)
        for p, r in _TEX:
            t = p.sub(r, t)
    if "markdown" in kinds or "wiki" in kinds:
        for p, r in _LIGHT:
            t = p.sub(r, t)
    # a formula may hold a piece that was set aside before it
    mark = re.compile(f"{begin}([0-9]+){end}")
    while mark.search(t):
        t = mark.sub(lambda m: kept[int(m.group(1))], t)
    return t


def clean_text(text: str | None, lost: frozenset[str] = frozenset()) -> tuple[list[str], str | None]:
    """(markup kinds, clean text). Null stays null; a text without markup is kept as it is."""
    kinds = kinds_of(text)
    if not kinds:
        return kinds, text
    t = text.replace("\r\n", "\n")
    if "html" in kinds:
        t = html_to_text(t, lost)
    if len(kinds) > ("html" in kinds):
        t = light_to_text(t, kinds)
    t = re.sub(r"[ \t]+\n", "\n", t)
    return kinds, re.sub(r"\n{3,}", "\n\n", t).strip()


# --- Spark -------------------------------------------------------------------------------------------


def host_of(url: str):
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit("-"))


def host_votes(df: DataFrame, text: str, url: str) -> DataFrame:
    """host, lost: per host the container paths that at least VOTERS pages have and whose summed score is not positive.

    A text counts against its path if REPEATED_PAGES different pages of the
    host have it there; copies of a page are one page. Pages without a url have
    no host and no vote. Scores are combined per batch and per task before the
    shuffle.
    """
    pages = df.where(F.contains(c(text), F.lit("<"))).select(host_of(url).alias("host"), c(text).alias("t")).where("host <> '-'").distinct()

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            sums: dict[tuple[str, str, str], list[int]] = {}
            for h, t in zip(b["host"], b["t"], strict=True):
                seen = set()
                for path, piece, link in path_pieces(t):
                    # the row without a piece counts the pages that have the path
                    for k, n in (((h, path, piece), len(piece)), ((h, path, ""), 0)):
                        x = sums.setdefault(k, [0, 0, 0])
                        x[0] += -n if link else n
                        x[1] += n
                        x[2] += k not in seen
                        seen.add(k)
            yield pd.DataFrame([(*k, *x) for k, x in sums.items()], columns=["host", "path", "piece", "score", "signs", "pages"])

    pieces = pages.mapInPandas(score, "host string, path string, piece string, score long, signs long, pages long")
    pieces = pieces.groupBy("host", "path", "piece").agg(F.sum("score").alias("score"), F.sum("signs").alias("signs"), F.sum("pages").alias("pages"))
    worth = F.when((F.col("piece") != "") & (F.col("pages") >= REPEATED_PAGES), -F.col("signs")).otherwise(F.col("score"))
    votes = pieces.groupBy("host", "path").agg(F.sum(worth).alias("score"), F.max(F.when(F.col("piece") == "", F.col("pages"))).alias("voters"))
    return votes.where((F.col("score") <= 0) & (F.col("voters") >= VOTERS)).groupBy("host").agg(F.collect_list("path").alias("lost"))


def clean_corpus(df: DataFrame, text: str, url: str) -> DataFrame:
    """``df`` with ``markup`` (array of kinds) and ``clean`` (text), extracted with the paths its host's pages agree on.

    Columns of these names are replaced. Rows of one host may be most of the
    table: the join spreads them.
    """
    columns_or_fail(df, text, url)
    keep = [x for x in df.columns if x.lower() not in ("markup", "clean")]

    @F.pandas_udf("struct<markup:array<string>,clean:string>")
    def run(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        memo: dict[tuple[str, ...], frozenset[str]] = {}
        rows = []
        for t, x in zip(texts, lost, strict=True):
            ks = frozenset() if x is None else memo.setdefault(tuple(x), frozenset(x))
            rows.append(clean_text(t, ks))
        return pd.DataFrame(rows, columns=["markup", "clean"])

    joined = lookup_join(df.select(*[c(x) for x in keep], host_of(url).alias("__host")), host_votes(df, text, url).withColumnRenamed("host", "__host"), "__host", "left")
    done = joined.withColumn("__r", run(c(text), F.col("lost")))
    return done.select(*[c(x) for x in keep], F.col("__r.markup").alias("markup"), F.col("__r.clean").alias("clean"))
