"""Host numbers beyond one group of an IPv6 address keep all digits in frames and in what is decoded of them."""

import datetime
import ipaddress

import pytest

from tidewire.decode.frames import decode
from tidewire.plans.frames import frames

#: Users that ask for AAAA (a multiple of 8, plus 1), up to and beyond 16 bits of user + 1.
USERS = (9, 65529, 65537, 76457, 2**31 + 1)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wide"))
    # odd events are replies, those on 7 and 9 without an answer; 23 makes IPv6 packets, here from server to client
    rows = [(e, datetime.datetime(2024, 1, 1), user, "purchase", 3.0) for e, user in zip((1, 3, 5, 11, 13), USERS)]
    rows += [(23 * k, datetime.datetime(2024, 1, 1), user, "signup", 3.0) for k, user in zip((1, 3, 5, 11, 13), USERS)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_answers_keep_all_digits_of_the_host(spark, sf):
    found = decode(frames(spark, sf)).where("dns is not null").selectExpr("number", "dns.answers[0].data as data").collect()
    wanted = [ipaddress.ip_address("2001:db8:53::") + user + 1 for user in USERS]
    assert [ipaddress.ip_address(row["data"]) for row in sorted(found)] == wanted


def test_addresses_are_written_in_groups(spark, sf):
    found = decode(frames(spark, sf)).where("ipv6 is not null").selectExpr("number", "ipv6.dst.text as text").collect()
    assert [row["text"] for row in sorted(found)] == [str(ipaddress.ip_address("2001:db8::") + user + 1) for user in USERS]
