"""The source of landed vendor pages, as a batch and as a stream."""

import json
import os

import pytest

from convoy.sources import adapters, pages


def _land(folder, provider, number, cursor, next_cursor, payload, tenant="acme"):
    os.makedirs(f"{folder}/{provider}", exist_ok=True)
    page = {"tenant_id": tenant, "fetched_at": "2026-09-08T14:30:00Z", "cursor": cursor, "next_cursor": next_cursor, "payload": payload}
    with open(f"{folder}/{provider}/{pages.file_name(number)}", "w") as f:
        json.dump(page, f)


def _chain(folder, provider, first, last):
    for n in range(first, last + 1):
        _land(folder, provider, n, f"c{n - 1}" if n > 1 else None, f"c{n}", {"n": n})


def _read(df):
    return sorted((r.provider, json.loads(r.payload)["n"]) for r in df.collect())


@pytest.fixture
def registered(spark):
    spark.dataSource.register(pages.VendorPages)
    return spark


def test_batches_read_up_to_the_first_gap(registered, tmp_path, monkeypatch):
    folder = f"{tmp_path}/in"
    _chain(folder, "samsara", 1, 150)
    _chain(folder, "motive", 2, 5)  # the first page is still to come
    _chain(folder, "lytx", 1, 2)
    _chain(folder, "lytx", 4, 4)
    df = registered.read.format("vendor_pages").option("path", folder).load()
    assert _read(df) == sorted([("samsara", n) for n in range(1, 151)] + [("lytx", 1), ("lytx", 2)])
    assert {(r.tenant_id, r.fetched_at.isoformat()) for r in df.limit(1).collect()} and df.rdd.getNumPartitions() == 4
    assert registered.read.format("vendor_pages").option("path", f"{tmp_path}/none").load().count() == 0


def test_a_page_out_of_its_chain_is_an_error(registered, tmp_path):
    folder = f"{tmp_path}/in"
    _chain(folder, "samsara", 1, 2)
    _land(folder, "samsara", 3, "other", "c3", {"n": 3})
    with pytest.raises(Exception, match="was asked for with 'other'"):
        registered.read.format("vendor_pages").option("path", folder).load().collect()


def test_a_restarted_stream_reads_each_page_once(registered, tmp_path):
    folder, seen = f"{tmp_path}/in", []

    def drain():
        def keep(batch, number):
            seen.extend(_read(batch))

        stream = registered.readStream.format("vendor_pages").option("path", folder).load()
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    _chain(folder, "samsara", 1, 3)
    _chain(folder, "motive", 2, 2)
    drain()
    assert seen == [("samsara", n) for n in (1, 2, 3)]
    drain()
    _chain(folder, "samsara", 4, 70)
    _chain(folder, "motive", 1, 1)
    drain()
    drain()
    assert sorted(seen) == sorted([("samsara", n) for n in range(1, 71)] + [("motive", 1), ("motive", 2)])


def test_pages_are_normalised_like_other_raw_records(registered, tmp_path):
    payload = {"logs": [{"log": {"driver": {"id": "d1", "username": "u"}, "date": "2026-09-08", "driving_time_remaining": 1500, "shift_time_remaining": 4200, "current_status": "driving", "updated_at": "2026-09-08T14:30:00.000Z"}}]}
    _land(f"{tmp_path}/in", "motive", 1, None, None, payload)
    raw = registered.read.format("vendor_pages").option("path", f"{tmp_path}/in").load()
    (row,) = adapters.normalise(raw).collect()
    assert (row.tenant_id, row.driver_id, row.kind, row.value) == ("acme", "d1", "hos-remaining", 25.0)
