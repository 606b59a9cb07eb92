"""Problem 1: clean text from wiki, HTML, Markdown and LaTeX markup, with its structure marked.

Method: a document is cut into blocks; headings, list entries, code and formulas
are structure and stay, the other blocks are classified in two passes. The first
pass goes by length, link density and stop-word density and decides the clear
ones; in the second, short and near-good blocks take the label of their nearest
decided neighbours.

Finding the blocks: opaque stretches (comments, literal text, code, formulas,
scripts) are lifted out in the order they start, so that nothing inside them is
read as markup; what is left is read line by line in the document's language,
HTML elements in any of them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING, LIST_ITEM, CODE, FORMULA, TEXT = "heading", "list_item", "code", "formula", "text"

#: Bounds of the first pass: characters of short and long blocks, shares of link text and of stop words.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.4, 0.03, 0.1
#: Stop words of the languages at hand (fixed values).
STOP_WORDS = frozenset(
    """và của là có trong cho với các những được khi thì mà ở từ đến này đó một không như về để theo sau trước trên dưới ngoài giữa gần tại do vì nên
    rồi còn lại đã đang sẽ bị bởi cùng cả năm người nhưng hay hoặc nếu tuy dù ra vào lên xuống
    the of and to in a an is was were that it on for as with by from at or be this which not had has are after before when because so
    le la les de des du et un une est en que qui dans pour par sur au aux avec ne pas ce cette il elle car quand après avant malgré""".split()
)
#: Templates whose last argument is shown where they stand (fixed values).
SHOWN = ("nowrap", "lang", "nobr", "small", "big", "abbr", "color", "font color", "underline", "sic", "transl", "smallcaps", "strong", "em", "bold", "italic")
#: LaTeX commands whose argument goes with them, and those whose last argument stays (fixed values).
GONE = "footnote|cite[a-z]*|label|ref|eqref|pageref|autoref|index|usepackage|documentclass|bibliography[a-z]*|vspace|hspace|includegraphics|input|pagestyle|title|author|date|thispagestyle|footnotemark|footnotetext|nocite"

_FLAGS = re.DOTALL | re.IGNORECASE | re.MULTILINE
_OPAQUE = re.compile(
    r"""<!--.*?(?:-->|\Z)
    | <nowiki\s*>(?P<literal>.*?)(?:</nowiki\s*>|\Z) | <nowiki\s*/>
    | <(?P<hidden>script|style|head|noscript|template)\b[^<>]*>.*?(?:</(?P=hidden)\s*>|\Z)
    | <(?P<codetag>pre|syntaxhighlight|source|code|tt|samp|listing|xmp)\b[^<>]*(?<!/)>(?P<code>.*?)(?:</(?P=codetag)\s*>|\Z)
    | <(?P<mathtag>math|chem)\b[^<>]*(?<!/)>(?P<math>.*?)(?:</(?P=mathtag)\s*>|\Z)
    | ^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*(?:\n|\Z)(?P<fenced>.*?)(?:^[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)
    | (?<!`)(?P<ticks>`{1,2})(?!`)(?P<inline>[^\n]*?[^`\n])(?P=ticks)(?!`)
    | (?<![\\$])\$\$(?P<display>.+?)\$\$
    | (?<![\\$\w])\$(?P<dollar>[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\d$])
    | (?<!\\)\\\[(?P<bracket>.+?)\\\]
    | (?<!\\)\\\((?P<paren>.+?)\\\)
    """,
    _FLAGS | re.VERBOSE,
)
_OPAQUE_TEX = re.compile(
    r"""(?<!\\)%[^\n]*(?:\n[ \t]*(?=\n)|(?=\n)|\Z)
    | \\begin\{(?P<codeenv>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:[ \t]*\[[^\]\n]*\])?(?:(?<=minted\})\{\w+\})?(?P<code>.*?)(?:\\end\{(?P=codeenv)\}|\Z)
    | \\begin\{(?P<mathenv>equation|align|gather|displaymath|math|eqnarray|multline|alignat|flalign)(?P<star>\*?)\}(?P<math>.*?)(?:\\end\{(?P=mathenv)(?P=star)\}|\Z)
    | \\(?:verb|lstinline)\*?(?P<bar>[^\w\s*])(?P<inline>[^\n]*?)(?P=bar)
    | (?<![\\$])\$\$(?P<display>.+?)\$\$
    | (?<![\\$])\$(?P<dollar>[^$]+?)(?<!\\)\$
    | (?<!\\)\\\[(?P<bracket>.+?)\\\]
    | (?<!\\)\\\((?P<paren>.+?)\\\)
    """,
    re.DOTALL | re.MULTILINE | re.VERBOSE,
)
_MATH = ("math", "display", "dollar", "bracket", "paren")
_TEX = re.compile(r"\\(?:(?:sub)*section|documentclass|begin|textbf|textit|emph|item|cite|footnote|href|chapter|paragraph)\b")
_WIKI = re.compile(r"\[\[|'''|\{\{|^={2,6}[^=\n].*?={2,6}\s*$|<ref\b|^\{\|", re.MULTILINE)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref\s*>)", _FLAGS)
_REFERENCES = re.compile(r"<references\b[^<>]*/?>|</references>", _FLAGS)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_TABLE = re.compile(r"^[ \t]*\{\|(?:(?!^[ \t]*\{\|).)*?^[ \t]*\|\}", re.DOTALL | re.MULTILINE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!(?:DOCTYPE|\[CDATA)[^<>]*>", re.IGNORECASE)
_BLOCK_TAG = re.compile(r"<(?P<close>/?)(?P<name>h[1-6]|li|ul|ol|p|div|br|table|tr|td|th|dl|dt|dd|blockquote|section|article|body|html|hr|center|figure|header|footer|nav|main|aside|form)\b[^<>]*>", re.IGNORECASE)
_HELD = re.compile("\x02(\\d+)\x03")
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*(.+?)[ \t]*(={1,6})[ \t]*$")
_WIKI_ITEM = re.compile(r"^([*#:;]*[*#])[ \t]*(.*)$")
_MD_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MD_UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_MD_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,9}[.)])[ \t]+(\S.*)$")
_MD_REFERENCE = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$")
_TEX_HEADING = re.compile(r"\\(?P<level>part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?[ \t]*(?:\[[^\]]*\])?[ \t]*(?=\{)")
_TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[[^\]]*\])?|\\(?P<what>begin|end)\{(?P<env>\w+)\*?\}(?:\[[^\]\n]*\])?")
_TEX_ACCENT = re.compile(r"\\([`'^\"~=.])\s*(?:\{\s*(\\?\w)\s*\}|(\\[ij](?![A-Za-z])|\w))|\\([uvHcdkrb])\{\s*(\\?\w)\s*\}")
#: Combining marks of LaTeX accent commands (fixed values).
_TEX_MARKS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "d": "̣", "k": "̨", "r": "̊", "b": "̱"}
_SPACES = re.compile(r"\s+")


def squeeze(text: str) -> str:
    """White space, no-break spaces included, as single spaces; ends trimmed."""
    return _SPACES.sub(" ", text.replace("\u200b", "").replace("\ufeff", "")).strip()


def _group(text: str, at: int) -> tuple[str, int]:
    """Content of the braces that open at `at`, and the place behind them."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{" and (i == 0 or text[i - 1] != "\\"):
            depth += 1
        elif c == "}" and text[i - 1] != "\\":
            depth -= 1
            if depth == 0:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


class Document:
    """One text read into blocks (kind, body, share of link text)."""

    def __init__(self, text: str) -> None:
        #: (kind, body, share of link text); the share is -1 for what stands inside another block's text.
        self.blocks: list[tuple[str, str, float]] = []
        self.held: list[tuple[str, str]] = []
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x02", " ").replace("\x03", " ")
        self.tex = bool(_TEX.search(text)) and not re.search(r"\[\[|</(?:p|div|h2|li)>", text)
        # Code may hold anything, so the language is decided for good when it has been lifted out.
        self.wiki = not self.tex and bool(re.search(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}", text))
        text = (_OPAQUE_TEX if self.tex else _OPAQUE).sub(self._lift, text)
        self.wiki = not self.tex and bool(_WIKI.search(text))
        if self.tex:
            self._read_tex(text)
        else:
            self._read_lines(text)

    def _lift(self, m: re.Match) -> str:
        found = m.groupdict()
        math = next((found[g] for g in _MATH if found.get(g) is not None), None)
        if math is not None:
            if self.wiki and found.get("dollar") is not None:
                return m[0]
            if not self.tex and (found.get("math") is not None or found.get("bracket") is not None or found.get("paren") is not None):
                math = html.unescape(math)
            return self._hold(FORMULA, math)
        if found.get("code") is not None:
            code, tag = found["code"], (found.get("codetag") or "").lower()
            if tag not in ("", "syntaxhighlight", "source"):
                code = re.sub(r"\A\s*<code\b[^<>]*>|</code\s*>\s*\Z", "", code, flags=re.IGNORECASE)
                code = html.unescape(code)
            return self._hold(CODE, code)
        for name in ("fenced", "inline"):
            if found.get(name) is not None:
                return self._hold(CODE, found[name])
        if found.get("literal") is not None:
            return self._hold("literal", html.unescape(found["literal"]))
        return ""

    def _hold(self, kind: str, body: str) -> str:
        self.held.append((kind, body))
        return f"\x02{len(self.held) - 1}\x03"

    def _shown(self, m: re.Match) -> str:
        """What a lifted stretch contributes to running text: formulas keep a mark, code is a block of its own."""
        kind, body = self.held[int(m[1])]
        return f"${squeeze(body)}$" if kind == FORMULA else "" if kind == CODE and "\n" in body.strip() else body

    def add(self, kind: str, raw: str) -> None:
        if kind == TEXT:
            self._add_text(raw)
            return
        body, _ = self.visible(raw)
        for m in _HELD.finditer(raw):
            self._add_held(int(m[1]), True)
        body = squeeze(_HELD.sub(self._shown, body))
        if body:
            self.blocks.append((kind, body, 0.0))

    def _add_held(self, n: int, inside: bool) -> None:
        kind, body = self.held[n]
        if kind in (CODE, FORMULA) and squeeze(body):
            self.blocks.append((kind, squeeze(body), -1.0 if inside and not (kind == CODE and "\n" in body.strip()) else 0.0))

    def _add_text(self, raw: str) -> None:
        body, linked = self.visible(raw)
        alone = not squeeze(_HELD.sub("", body)).strip(".,;:")
        shown = "" if alone and not any(self.held[int(m[1])][0] == "literal" for m in _HELD.finditer(body)) else squeeze(_HELD.sub(self._shown, body))
        if shown:
            self.blocks.append((TEXT, shown, linked / max(1, len(shown))))
        for m in _HELD.finditer(raw):
            self._add_held(int(m[1]), bool(shown))

    # Inline markup

    def visible(self, raw: str) -> tuple[str, int]:
        """Visible text of inline markup and the number of characters in link labels."""
        linked = 0

        def label(text: str) -> str:
            nonlocal linked
            linked += len(text)
            return text

        if self.tex:
            return self._tex_visible(raw, label), linked
        text = raw
        if "[" in text:
            if self.wiki:
                text = re.sub(r"\[\[[ \t]*(?:thể loại|category|tập tin|file|image|hình|[a-z]{2,3}(?:-[a-z]+)?)[ \t]*:[^\[\]]*\]\]", "", text, flags=re.IGNORECASE)
                text = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", lambda m: label(m[1]), text)
                text = re.sub(r"\[(?:https?:|ftp:|mailto:|//)[^\s\[\]]*[ \t]*([^\[\]]*)\]", lambda m: label(m[1]), text)
            else:
                text = re.sub(r"!\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])", r"\1", text)
                text = re.sub(r"\[\^[^\[\]]+\]", "", text)
                text = re.sub(r"\[([^\[\]]*)\]\((?:<[^<>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\)", lambda m: label(m[1]), text)
                text = re.sub(r"\[([^\[\]]+)\][ ]?\[[^\[\]]*\]", lambda m: label(m[1]), text)
        if "<" in text:
            for m in re.finditer(r"<a\b[^<>]*>(.*?)</a\s*>", text, _FLAGS):
                linked += len(m[1])
            text = re.sub(r"<br\b[^<>]*>", " ", text, flags=re.IGNORECASE)
            text = re.sub(r"<(https?://[^<>\s]+)>", r"\1", text)
            text = _TAG.sub("", text)
        if self.wiki:
            text = re.sub(r"'{2,5}", "", text)
        else:
            text = re.sub(r"(?<!\\)(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s\\*])\1", r"\2", text, flags=re.DOTALL)
            text = re.sub(r"(?<![\w\\])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s\\_])\1(?!\w)", r"\2", text, flags=re.DOTALL)
            text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", text)
            text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|~$>])", r"\1", text)
        return (html.unescape(text) if "&" in text else text), linked

    def _tex_visible(self, text: str, label) -> str:
        text = re.sub(r"\\[a-zA-Z]*accent\b", "", text)
        text = _TEX_ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3] or m[5]).lstrip("\\") + _TEX_MARKS[m[1] or m[4]]), text)
        out, i = [], 0
        while (m := re.compile(r"\\([a-zA-Z]+)\*?[ \t]*|\\(.)|[{}~]", re.DOTALL).search(text, i)) is not None:
            out.append(text[i : m.start()])
            i = m.end()
            if m[1] is None:
                if m[2] is None:
                    out.append(" " if m[0] == "~" else "")
                elif m[2] == "\\":
                    out.append(" ")
                    if (o := re.match(r"\*?\[[^\]\n]*\]", text[i:])) is not None:
                        i += o.end()
                else:
                    out.append({",": " ", ";": " ", ":": " ", "!": "", "-": "", "/": "", "@": ""}.get(m[2], m[2]))
                continue
            if (o := re.match(r"\[[^\]\n]*\]", text[i:])) is not None:
                i += o.end()
            if re.fullmatch(GONE, m[1]):
                while i < len(text) and text[i] == "{":
                    _, i = _group(text, i)
            elif m[1] in ("href", "hyperref", "textcolor", "colorbox") and i < len(text) and text[i] == "{":
                _, i = _group(text, i)
                if i < len(text) and text[i] == "{":
                    inner, i = _group(text, i)
                    out.append(label(self._tex_visible(inner, lambda t: t)))
            elif m[1] in ("begin", "end") and i < len(text) and text[i] == "{":
                _, i = _group(text, i)
            elif m[1] in ("ldots", "dots", "textellipsis"):
                out.append("…")
            elif m[1] in ("textbackslash",):
                out.append("\\")
            elif m[1] in ("dj", "DJ"):
                out.append({"dj": "đ", "DJ": "Đ"}[m[1]])
            elif m[1] in ("quad", "qquad", "par", "newline", "space", "medskip", "bigskip", "smallskip"):
                out.append(" ")
        out.append(text[i:])
        return "".join(out).replace("``", "“").replace("''", "”").replace("---", "—")

    # LaTeX

    def _read_tex(self, text: str) -> None:
        if "\\begin{document}" in text:
            text = text.split("\\begin{document}", 1)[1]
        text = text.split("\\end{document}", 1)[0]
        parts, at = [], 0
        for m in _TEX_HEADING.finditer(text):
            if m.start() < at:
                continue
            title, end = _group(text, m.end())
            parts += [(TEXT, text[at : m.start()]), (HEADING, title)]
            at = end
        parts.append((TEXT, text[at:]))
        for kind, part in parts:
            if kind == HEADING:
                self.add(HEADING, part)
            else:
                self._read_tex_body(part)

    def _read_tex_body(self, text: str) -> None:
        """Paragraphs and the items of bulleted and numbered lists."""
        lists: list[bool] = []
        inside, at = False, 0

        def flush(until: int) -> None:
            piece = text[at:until]
            if inside:
                self.add(LIST_ITEM, piece)
            else:
                for paragraph in re.split(r"\n[ \t]*\n", piece):
                    self.add(TEXT, paragraph)

        for m in _TEX_ITEM.finditer(text):
            if m["what"] is None:
                if lists:
                    flush(m.start())
                    at, inside = m.end(), lists[-1]
            elif m["env"] in ("itemize", "enumerate", "description", "compactitem", "compactenum"):
                flush(m.start())
                at, inside = m.end(), False
                if m["what"] == "begin":
                    lists.append(m["env"] != "description")
                elif lists:
                    lists.pop()
        flush(len(text))

    # Wiki, Markdown and HTML

    def _read_lines(self, text: str) -> None:
        if self.wiki:
            text = _REFERENCES.sub("", _REF.sub("", text))
            for _ in range(40):
                text, n = _TEMPLATE.subn(self._template, text)
                if not n:
                    break
            while (cut := _TABLE.sub("\n", text)) != text:
                text = cut
        else:
            text = re.sub(r"<sup\b[^<>]*class=[\"']?reference.*?</sup\s*>", "", text, flags=_FLAGS)
        self._read_html(text)

    def _template(self, m: re.Match) -> str:
        name, *args = m[1].split("|")
        if name.strip().lower() not in SHOWN:
            return ""
        shown = [a for a in args if not re.match(r"\s*[\w ]+=", a)]
        return shown[-1] if shown else ""

    def _read_html(self, text: str) -> None:
        """HTML headings and list entries; everything else goes on by lines."""
        rest: list[str] = []
        stack: list[list[str] | None] = []
        level, heading = 0, None
        at = 0

        def put(piece: str) -> None:
            if heading is not None:
                heading.append(piece)
            elif stack and stack[-1] is not None:
                stack[-1].append(piece)
            else:
                rest.append(piece)

        def close_item() -> None:
            if stack and stack[-1] is not None:
                pieces = stack[-1]
                stack[-1] = None
                if pieces:
                    self._flush(rest)
                    self.add(LIST_ITEM, "".join(pieces))

        for m in _BLOCK_TAG.finditer(text):
            put(text[at : m.start()])
            at = m.end()
            name, closing = m["name"].lower(), bool(m["close"])
            if name[0] == "h" and name[1:].isdigit():
                if heading is not None:
                    self._flush(rest)
                    if level > 1:
                        self.add(HEADING, "".join(heading))
                    heading = None
                if not closing:
                    while stack:
                        close_item()
                        stack.pop()
                    level, heading = int(name[1]), []
            elif heading is not None:
                heading.append(" ")
            elif name in ("ul", "ol"):
                if closing:
                    close_item()
                    if stack:
                        stack.pop()
                else:
                    if stack and stack[-1]:
                        # Nested entries stand on their own; what the outer one says before them is its text.
                        pieces, stack[-1] = stack[-1], []
                        self._flush(rest)
                        self.add(LIST_ITEM, "".join(pieces))
                    stack.append(None)
            elif name == "li":
                close_item()
                if not closing:
                    if not stack:
                        stack.append(None)
                    stack[-1] = []
            else:
                put(" " if stack and stack[-1] is not None or name == "br" else "\n\n" if name not in ("td", "th") else " ")
        put(text[at:])
        if heading is not None and level > 1:
            self._flush(rest)
            self.add(HEADING, "".join(heading))
        while stack:
            close_item()
            stack.pop()
        self._flush(rest)

    def _flush(self, rest: list[str]) -> None:
        text = "".join(rest)
        rest.clear()
        if not text.strip():
            return
        paragraph: list[str] = []

        def end() -> None:
            if paragraph:
                self.add(TEXT, "\n".join(paragraph))
                paragraph.clear()

        # A tag may run over the end of a line.
        text = re.sub(r"<[a-zA-Z/][^<>]*>", lambda m: m[0].replace("\n", " "), text)
        for line in text.split("\n"):
            bare = line.strip()
            if not bare:
                end()
                continue
            if self.wiki:
                if (m := _WIKI_HEADING.match(line)) is not None:
                    end()
                    n = min(len(m[1]), len(m[3]))
                    title = "=" * (len(m[1]) - n) + m[2] + "=" * (len(m[3]) - n)
                    self.add(HEADING if n > 1 else TEXT, title)
                    continue
                if (m := _WIKI_ITEM.match(line)) is not None:
                    end()
                    self.add(LIST_ITEM, m[2])
                    continue
                if line[0] in ":;" or line[0] == "|":
                    end()
                    self.add(TEXT, line.lstrip(":;"))
                    continue
                paragraph.append(line)
                continue
            if _MD_REFERENCE.match(line):
                continue
            if (m := _MD_HEADING.match(line)) is not None:
                end()
                self.add(HEADING if len(m[1]) > 1 else TEXT, m[2] or "")
                continue
            if paragraph and (m := _MD_UNDER.match(line)) is not None:
                title = "\n".join(paragraph)
                paragraph.clear()
                self.add(HEADING if m[1][0] == "-" else TEXT, title)
                continue
            if _MD_RULE.match(line):
                end()
                continue
            if (m := _MD_ITEM.match(line)) is not None:
                end()
                self.add(LIST_ITEM, m[1])
                continue
            if bare[0] == "|":
                end()
                if not re.fullmatch(r"[|:\- ]+", bare):
                    self.add(TEXT, bare.strip("|").replace("|", " | "))
                continue
            paragraph.append(re.sub(r"^ {0,3}(?:> ?)+", "", line))
        end()


def first_pass(body: str, links: float) -> str:
    """good, bad, near or short, by the block alone."""
    if links > LINKS:
        return "bad"
    if len(body) < SHORT:
        return "bad" if links > 0.25 else "short"
    words = body.lower().split()
    stops = sum(w.strip(".,;:!?…()\"“”") in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH:
        return "good" if len(body) > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def second_pass(labels: list[str]) -> list[str]:
    """good or bad for each; undecided blocks look to the nearest decided ones on both sides."""
    n = len(labels)
    before, after = ["bad"] * n, ["bad"] * n
    last = "bad"
    for i in range(n):
        before[i] = last
        if labels[i] in ("good", "bad"):
            last = labels[i]
    last = "bad"
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] in ("good", "bad"):
            last = labels[i]
    decided = any(x in ("good", "bad") for x in labels)
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label)
        elif label == "near":
            out.append("bad" if decided and before[i] == after[i] == "bad" and "good" in labels else "good")
        else:
            around = {before[i], after[i]}
            near = any(x == "near" for x in labels[max(0, i - 1) : i + 2])
            out.append("good" if not decided or around == {"good"} or len(around) == 2 and near else "bad")
    return out


def blocks(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, body, label) of a text's blocks in order; structure is good, or inside where a text block shows it too."""
    if not text or not text.strip():
        return []
    found = Document(text).blocks
    at = [i for i, b in enumerate(found) if b[0] == TEXT]
    labels = dict(zip(at, second_pass([first_pass(found[i][1], found[i][2]) for i in at])))
    return [(kind, body, labels.get(i, "inside" if links < 0 else "good")) for i, (kind, body, links) in enumerate(found)]


_MARKED = {HEADING: "## {}", LIST_ITEM: "- {}", CODE: "```\n{}\n```", FORMULA: "$${}$$", TEXT: "{}"}


def clean(text: str | None) -> str | None:
    """The text without markup; headings, entries, code and formulas keep a plain mark, bad blocks are left out."""
    if text is None:
        return None
    out: list[str] = []
    previous = ""
    for kind, body, label in blocks(text):
        if label == "good":
            out.append(("\n" if kind == previous == LIST_ITEM else "\n\n" if out else "") + _MARKED[kind].format(body))
            previous = kind
    return "".join(out)


def marked_blocks(df: DataFrame, key: str = "revision_id", text: str = "wikitext", structure_only: bool = False) -> DataFrame:
    """(key, seq, kind, body, label): the blocks of every document, in order.

    Null, empty and blank texts have no blocks. Markup left open runs to the end
    of the text; stray closings are text or vanish like other formatting. Rows
    that repeat a document repeat its blocks. Null keys are left out. Texts are
    read whole.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, seq int, kind string, body string, label string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seq, kinds, bodies, labels = [], [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for n, (kind, shown, label) in enumerate(blocks(body)):
                    if kind != TEXT or not structure_only:
                        at.append(i)
                        seq.append(n)
                        kinds.append(kind)
                        bodies.append(shown)
                        labels.append(label)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(seq, pa.int32()), pa.array(kinds, pa.string()), pa.array(bodies, pa.string()), pa.array(labels, pa.string())], names=[key, "seq", "kind", "body", "label"])

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).cast("string"))
    return rows.mapInArrow(read, schema)


def clean_texts(df: DataFrame, key: str = "revision_id", text: str = "wikitext") -> DataFrame:
    """(key, text): every document as clean text; null stays null, empty empty. Rows are not joined or dropped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(read, f"{key} {dict(df.dtypes)[key]}, text string")
