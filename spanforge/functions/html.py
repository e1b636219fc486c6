"""HTML as a flat list of events, which every reader of pages folds in its own way."""

from __future__ import annotations

from html.parser import HTMLParser

Event = tuple[str, str, dict]


def events(html: str) -> list[Event]:
    """("start", tag, attributes), ("end", tag, {}) and ("text", text, {}) in order; entities are resolved."""
    out: list[Event] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_starttag = lambda tag, attrs: out.append(("start", tag, {k: v or "" for k, v in attrs}))
    parser.handle_endtag = lambda tag: out.append(("end", tag, {}))
    parser.handle_data = lambda text: out.append(("text", text, {}))
    parser.feed(html)
    parser.close()
    return out
