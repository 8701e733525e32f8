"""A fetcher for tests, found by name: answers from a folder and notes each request in it."""

import json
import os
import tempfile
import uuid
from urllib.parse import parse_qs, urlsplit

from tidemark.sources.search import HttpError

#: Names the folder; workers don't share the tests' environment.
POINTER = os.path.join(tempfile.gettempdir(), f"tidemark-search-fixture-{os.getuid()}")


def answer(payload: dict) -> str:
    with open(POINTER) as f:
        folder = f.read()
    query = payload["body"]["query"] if "body" in payload else parse_qs(urlsplit(payload["url"]).query)["q"][0].split(" after:")[0]
    with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
        f.write(query)
    if query == "busy" and not os.path.exists(f"{folder}/busy"):
        open(f"{folder}/busy", "w").close()
        raise HttpError(429)
    if query == "broken":
        return "no feed"
    if query == "down":
        raise HttpError(404)
    items = [{"title": "T", "url": "https://a.com/x?utm_source=q", "content": ""}, {"title": query, "url": f"https://a.com/{query}", "content": "s"}]
    if "body" in payload:
        return json.dumps({"results": items})
    return "<rss><channel>" + "".join(f"<item><title>{x['title']}</title><link>{x['url']}</link></item>" for x in items) + "</channel></rss>"


def page(url: str) -> tuple[bytes, dict]:
    """The statement page of that name in the folder; each request is noted."""
    with open(POINTER) as f:
        folder = f.read()
    with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
        f.write(url)
    with open(f"{folder}/{url[-13:-5]}.htm", "rb") as f:
        return f.read(), {"status": 200, "final_url": url}
