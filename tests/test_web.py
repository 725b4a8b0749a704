"""Pages by HTTP from a server on this machine."""

import http.server
import threading

import pytest

from heddle.sources import web


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        found = {"/": (200, "text/html", "<p>grüße</p>".encode()), "/latin": (200, "text/html; charset=latin-1", "é".encode("latin-1")), "/odd": (200, "text/html; charset=nonsense", b"a\xff"), "/empty": (200, "text/html", b""), "/none": (204, "text/html", b"")}
        status, kind, body = found.get(self.path, (404, "text/html", b"no such page"))
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def wanted(site):
    return {f"{site}/": (200, "<p>grüße</p>"), f"{site}/latin": (200, "é"), f"{site}/odd": (200, "a�"), f"{site}/empty": (200, ""), f"{site}/none": (204, None), f"{site}/gone": (404, None), "http://127.0.0.1:1/": (None, None), "file:///etc/hostname": (None, None)}


def test_pages_of_a_table_of_urls(spark, site):
    rows = [(url, 1) for url in wanted(site)] + [(f"{site}/", 2), (None, 3), ("http://[", 4)]
    got = web.fetch(spark.createDataFrame(rows, "link string, status int").repartition(3), "link").collect()
    assert len(got) == len(rows)
    assert {r["url"]: (r["status"], r["html"]) for r in got} == wanted(site) | {None: (None, None), "http://[": (None, None)}
    assert all((r["error"] is None) == (r["status"] == 200) for r in got)
    assert web.fetch(spark.createDataFrame([], "url string")).collect() == []


def test_pages_as_a_data_source(spark, site):
    spark.dataSource.register(web.PageSource)
    got = spark.read.format("pages").option("urls", "\n".join(wanted(site))).option("tasks", "3").load()
    assert {r["url"]: (r["status"], r["html"]) for r in got.collect()} == wanted(site)
    assert spark.read.format("pages").load().collect() == []


def test_entry_page(site):
    assert web.check_entry(f"{site}/") == f"{site}/"
    for url in (f"{site}/gone", f"{site}/none", "http://127.0.0.1:1/", "file:///etc/hostname"):
        with pytest.raises(ValueError):
            web.check_entry(url)
