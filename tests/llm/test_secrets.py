"""Secret scans of hostile texts: the time goes with the length."""

import base64
import time

import pytest

from metaloom.llm import secret_scan

MB = 1 << 20
START = bytes.fromhex("3082ffff02010002")
LONG = bytes.fromhex("3083fffff0020100")
FAKE = bytes.fromhex("3082fff00201000282ffe9")
HOSTILE = {
    "spaces": "-----BEGIN PRIVATE KEY-----" + " " * MB,
    "spaces and end": "-----BEGIN PRIVATE KEY-----" + " " * MB + "-----END RSA PRIVATE KEY-----",
    "begins": "-----BEGIN PRIVATE KEY-----\n" * (MB // 28),
    "begins and one end": "-----BEGIN PRIVATE KEY-----\nMIIE\n" * (MB // 33) + "-----END PRIVATE KEY-----",
    "headers": "-----BEGIN PRIVATE KEY-----\n" + "a: b\n" * (MB // 5),
    "starts": base64.b64encode(START * (MB * 3 // 4 // 8)).decode(),
    "long starts": base64.b64encode(LONG * (MB * 3 // 4 // 8)).decode(),
    "fake nests": base64.b64encode(FAKE * (MB * 3 // 4 // 11)).decode(),
    "hex starts": (START * (MB // 16)).hex(),
    "hex long": (LONG * (MB // 16)).hex(),
    "magics": (secret_scan.MAGIC64.decode() + "AAAABG5vbmU") * (MB // 31),
    "escaped ends": "-----BEGIN PRIVATE KEY-----" + "\\n" * (MB // 2),
    "lines": ("A" * 64 + "\n  ") * (MB // 67),
    "eyes": "ey" * (MB // 2),
    "dots": "eyAAAAAAAAAA.AA." * (MB // 16),
    "secrets": "secret " * (MB // 7),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_a_megabyte_takes_less_than_two_seconds(kind):
    began = time.process_time()
    secret_scan.find_spans(HOSTILE[kind])
    assert time.process_time() - began < 2


def test_an_end_of_another_name_and_a_second_begin():
    ed = base64.b64encode(bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))).decode()
    kinds = lambda t: [(secret_scan.KINDS[k], a, b) for a, b, k in secret_scan.find_spans(t) if k >= secret_scan.BASE]
    good = f"-----BEGIN PRIVATE KEY-----\n{ed}\n-----END PRIVATE KEY-----"
    assert kinds(good) == [("pem", 0, len(good))]
    assert kinds("-----BEGIN PRIVATE KEY-----\n" + good) == [("pem", 28, 28 + len(good))]
    assert [k for k, _, _ in kinds(good.replace("END", "END EC"))] == ["der"]
    assert kinds("-----BEGIN PRIVATE KEY-----" + " " * 5000 + ed + " " * 5000 + "-----END PRIVATE KEY-----")[0][0] == "pem"


@pytest.mark.parametrize("text", [None, "", " ", "é" * 50])
def test_nothing_to_find(text):
    assert secret_scan.find_spans(text) == []
