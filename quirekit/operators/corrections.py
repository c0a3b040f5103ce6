"""Corrections (§2.13): a relational plan of ordered patches, and their application document by document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.similarity import fuzzy
from ..sources import dom

#: Order of application, content first, then structure, then looks; other actions before manual ones.
ACTION_ORDER = {
    "SET_ALT_TEXT": 0, "FIX_IMAGE_SRC": 1, "REPLACE_IMAGE": 1, "INSERT_IMAGE": 2, "INSERT_TEXT": 3, "INSERT_SECTION": 3, "REMOVE_WATERMARK": 4, "REMOVE_ELEMENT": 4,
    "FIX_HEADING_LEVEL": 5, "ADJUST_ALIGNMENT": 6, "REORDER_ELEMENT": 7, "MANUAL": 9,
}
OTHER_ACTION = 8
ALIGNMENT_STYLES = {
    "center": "display:block;margin-left:auto;margin-right:auto;text-align:center",
    "left": "display:block;margin-left:0;margin-right:auto;text-align:left",
    "right": "display:block;margin-left:auto;margin-right:0;text-align:right",
}
#: Attribute that marks what a correction put into a document.
MARK = "data-inserted"
#: A watermark's element with more text than this loses the phrase alone.
LONG_TEXT = 160


def action_rank(action: Column) -> Column:
    """O2; no action ranks as an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ACTION_ORDER.items() for x in kv)), action), F.lit(OTHER_ACTION))


def plan(issues: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Every finding (doc, status, action, confidence, auto_fixable, list, seq) with ``apply``, ``reason`` and ``step``, its place in the document's order of application."""
    rows = issues.withColumn("__d", classify.fix_decision(F.col("status"), F.col("action").isNotNull(), F.col("auto_fixable"), F.col("confidence"), threshold))
    step = F.row_number().over(W.partitionBy("doc").orderBy(action_rank(F.col("action")), F.desc("confidence"), "list", "seq"))
    return rows.withColumns({"apply": F.col("__d.apply"), "reason": F.col("__d.reason"), "step": step}).drop("__d")


def _normal(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


def _in_chrome(node: dom.Node) -> bool:
    return any(a.tag in dom.CHROME for a in node.ancestors())


def _file(src: str) -> str:
    return re.sub(r"[?#].*$", "", src).rstrip("/").rsplit("/", 1)[-1]


class Patcher:
    """Applies patches to one document's tree."""

    def __init__(self, markup: str | None):
        self.root = dom.parse(markup)
        self.chains: dict[int, dom.Node] = {}
        # Paths are those of the document as it was compared; nodes keep them while they move.
        self.at = {path: node for node, path in self._named()}

    def _named(self):
        paths = dom.paths(self.root)
        return [(n, paths[id(n)]) for n in self.root.elements()]

    def _alive(self, node: dom.Node) -> bool:
        return any(a is self.root for a in node.ancestors())

    def resolve(self, path: str | None, text: str | None = None, src: str | None = None, content: bool = False) -> dom.Node | None:
        """The element at a path if it holds what is expected, else the one with that source, else the one whose own text is most like the expected, by 0.9. ``content`` refuses the page's header, menus and footer."""
        node = self.at.get(path or "")
        if node is not None and self._alive(node) and self._fits(node, text, src) and not (content and _in_chrome(node)):
            return node
        if src:
            for n in self.root.elements():
                if n.tag == "img" and n.attrs.get("src") and (n.attrs["src"] == src or _file(n.attrs["src"]) == _file(src) != ""):
                    return n
        wanted = _normal(text or "")
        best, score = None, 0.0
        if wanted:
            for n in dom.body(self.root).elements():
                if n.tag in dom.RAW or (content and (n.tag in dom.CHROME or _in_chrome(n))):
                    continue
                if (own := _normal(n.own_text())) and (s := fuzzy(wanted, own)) > score:
                    best, score = n, s
        return best if score >= 0.9 else None

    def _fits(self, node: dom.Node, text: str | None, src: str | None) -> bool:
        if src:
            image = node if node.tag == "img" else node.find("img")
            own = image.attrs.get("src", "") if image is not None else ""
            return bool(own) and (own == src or _file(own) == _file(src))
        return not _normal(text or "") or fuzzy(_normal(text), _normal(node.text())) >= 0.6

    def apply(self, action: str, path: str | None, p: dict[str, str]) -> str | None:
        """None, or why the patch couldn't be applied."""
        handler = getattr(self, f"_{action.lower()}", None)
        return handler(path, p) if handler else f"unsupported action {action}"

    def _target(self, path: str | None, p: dict[str, str], content: bool = False) -> dom.Node | None:
        return self.resolve(path, p.get("target_text"), p.get("target_src"), content)

    def _image(self, path: str | None, p: dict[str, str]) -> dom.Node | None:
        node = self._target(path, p)
        return node if node is None or node.tag == "img" else node.find("img")

    def _set_alt_text(self, path, p):
        node = self._image(path, p)
        if node is None:
            return "target not found"
        node.attrs["alt"] = p.get("alt", "")

    def _replace_image(self, path, p):
        node = self._image(path, p)
        if node is None:
            return "target is not an image"
        if not p.get("hosted_url"):
            return "no replacement figure available"
        node.attrs["src"] = p["hosted_url"]
        for name in ("srcset", "data-src", "data-srcset", "data-original", "data-lazy-src"):
            node.attrs.pop(name, None)
        if p.get("alt"):
            node.attrs["alt"] = p["alt"]
        node.attrs[MARK] = "replaced"

    _fix_image_src = _replace_image

    def _insert_image(self, path, p):
        anchor = self._target(path, p, content=True)
        if anchor is None:
            return "no anchor in the content"
        if not p.get("hosted_url"):
            return "figure is not available"
        image = dom.Node("img", {"src": p["hosted_url"], MARK: "image", "alt": p.get("alt") or p.get("caption") or "", "loading": "lazy"})
        host = next((a for a in anchor.ancestors() if a.tag == "figure"), None)
        if host is not None and anchor.tag in ("figcaption", "caption"):
            anchor.before(image)
            return None
        figure = dom.Node("figure", {MARK: "image"})
        figure.append(image)
        if p.get("caption"):
            caption = dom.Node("figcaption")
            caption.append(p["caption"])
            figure.append(caption)
        (host or anchor).before(figure) if p.get("position") == "before" else (host or anchor).after(figure)

    def _insert_text(self, path, p):
        anchor = self._target(path, p, content=True)
        if anchor is None:
            return "no anchor in the content"
        node = dom.Node(p.get("tag") or "p", {MARK: "text"})
        node.append(p.get("text", ""))
        if p.get("position") == "append" or (node.tag == "li" and anchor.tag in ("ol", "ul")):
            box = anchor if anchor.tag in ("ol", "ul") else anchor.parent
            items = [c for c in box.children if isinstance(c, dom.Node) and c.tag == "li"]
            at = p.get("index", "")
            items[int(at)].before(node) if at.isdigit() and int(at) < len(items) else box.append(node)
            return None
        if node.tag != "li" and anchor.tag == "li":
            anchor = next((a for a in anchor.ancestors() if a.tag in ("ul", "ol")), anchor)
        if p.get("position") == "before":
            anchor.before(node)
            return None
        # What shares an anchor stands in the order of its insertion.
        last = self.chains.get(id(anchor))
        (last if last is not None and last.parent is not None else anchor).after(node)
        self.chains[id(anchor)] = node

    def _insert_section(self, path, p):
        anchor = self._target(path, p, content=True)
        if anchor is None:
            return "no anchor in the content"
        node = dom.Node(f"h{max(1, min(6, int(p.get('level') or 2)))}", {MARK: "section"})
        node.append(p.get("title", ""))
        anchor.before(node) if p.get("position") == "before" else anchor.after(node)

    def _fix_heading_level(self, path, p):
        node = self._target(path, p)
        if node is None:
            return "target not found"
        node.tag = f"h{max(1, min(6, int(p.get('level') or 2)))}"

    def _remove_element(self, path, p):
        node = self._target(path, p)
        if node is None:
            return "target not found"
        node.detach()

    def _remove_watermark(self, path, p):
        node = self._target(path, p)
        if node is None:
            return "target not found"
        if len(node.text()) > LONG_TEXT and p.get("text"):
            for n in (node, *node.elements()):
                n.children[:] = [re.sub(re.escape(p["text"]), "", c, flags=re.I) if isinstance(c, str) and not isinstance(c, dom.Comment) else c for c in n.children]
            return None
        node.detach()

    def _adjust_alignment(self, path, p):
        node = self._target(path, p)
        if node is None:
            return "target not found"
        style = ALIGNMENT_STYLES.get(p.get("align", "center"))
        if style is None:
            return f"unknown alignment {p.get('align')}"
        box = next((a for a in node.ancestors() if a.tag == "figure"), node)
        rules = dict(x.strip().split(":", 1) for x in (box.attrs.get("style", "") + ";" + style).split(";") if ":" in x)
        box.attrs["style"] = ";".join(f"{k.strip()}:{v.strip()}" for k, v in rules.items())

    @staticmethod
    def _block(heading: dom.Node) -> list[dom.Node]:
        """A heading and what follows it up to the next heading of its level or a higher one."""
        if heading.tag not in dom.HEADINGS:
            return [heading]
        out = [heading]
        for c in heading.parent.children[heading.index() + 1 :]:
            if isinstance(c, dom.Node):
                if c.tag in dom.HEADINGS and c.tag <= heading.tag:
                    break
                out.append(c)
        return out

    def _reorder_element(self, path, p):
        node = self._target(path, p, content=True)
        after = self.resolve(p.get("after_dom_path"), p.get("after_text"), content=True)
        if node is None or after is None or after is node:
            return "anchor not found"
        block = self._block(node) if p.get("scope") == "section" else [node]
        if any(after is b or any(a is b for a in after.ancestors()) for b in block) or any(a is after for a in node.ancestors()):
            return "anchor and target overlap"
        if p.get("after_scope") == "section":
            after = self._block(after)[-1]
            if any(after is b for b in block):
                return "anchor and target overlap"
        for b in block:
            after.after(b.detach())
            after = b

    def html(self) -> str:
        return dom.serialize(self.root)


def _patch(pages: pa.Table, steps: pa.Table) -> pa.Table:
    markups = pages.column("html").to_pylist()
    out, done = [], []
    for markup in markups:
        p = Patcher(markup)
        done = []
        for step, action, path, payload in sorted(zip(*(steps.column(c).to_pylist() for c in ("step", "action", "target", "payload")), strict=True), key=lambda x: x[0]):
            try:
                error = p.apply(action, path, dict(payload or []))
            except (ValueError, IndexError, AttributeError, StopIteration) as e:  # one bad patch must not lose the others
                error = f"correction error: {e}"
            done.append({"step": step, "error": error})
        out.append(p.html())
    n = len(markups)
    return pa.table({"doc": pa.array([pages.column("doc")[0].as_py()] * n, pa.int64()), "html": pa.array(out, pa.string()), "steps": pa.array([done] * n, pa.list_(pa.struct([("step", pa.int32()), ("error", pa.string())])))}) if n else pa.table({"doc": pa.array([], pa.int64()), "html": pa.array([], pa.string()), "steps": pa.array([], pa.list_(pa.struct([("step", pa.int32()), ("error", pa.string())])))})


def applied(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """Documents (doc, html) with the planned patches that are to be applied: doc, html, and ``steps`` with the error of each, null where it took hold.

    A task holds one document and its patches. A document without patches comes
    back as it is parsed; patches of no document are left out.
    """
    todo = planned.where("apply").select(F.col("doc").cast("long").alias("doc"), F.col("step").cast("int").alias("step"), "action", "target", "payload")
    own = pages.select(F.col("doc").cast("long").alias("doc"), F.col("html").cast("string").alias("html"))
    return own.groupBy("doc").cogroup(todo.groupBy("doc")).applyInArrow(_patch, "doc long, html string, steps array<struct<step: int, error: string>>")


def stamped(html: Column, n_applied: Column, at: str) -> Column:
    """The document without base tags, with a comment before the end of its head that says what was applied."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?i)<base\b[^>]*>", ""), r"<!-- corrections: [^>]*-->", "")
    return F.regexp_replace(plain, r"(?i)</head>", F.concat(F.lit("<!-- corrections: "), n_applied.cast("string"), F.lit(f" applied {at} --></head>")))


def frozen(html: Column) -> Column:
    """Scripts that would undo the corrections removed; the data they hold stays."""
    return F.regexp_replace(html, r'(?is)<script\b(?![^>]*application/(?:ld\+)?json)[^>]*>.*?</script>', "")
