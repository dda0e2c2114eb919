"""Private keys in the layouts that they are pasted in."""

import base64

import pytest

from lodestrand.llm import secrets
from tests.llm.test_small_ops import rsa_key


def ssh_key():
    s = lambda x: len(x).to_bytes(4, "big") + x
    return secrets.SSH_MAGIC + s(b"none") + s(b"none") + s(b"") + b"\0\0\0\1" + s(s(b"ssh-ed25519") + s(b"k" * 32)) + s(b"p" * 64)


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    ", "\n\t", " ", ""])
@pytest.mark.parametrize("kind", ["der", "ssh"])
def test_wrapped_keys_are_found_whole(gap, kind):
    b64 = base64.b64encode(rsa_key() if kind == "der" else ssh_key()).decode()
    body = gap.join(b64[i : i + 64] for i in range(0, len(b64), 64))
    for before, after in (("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"), ('{"k": "', '"}'), ("MAMAMIMI" * 8, " x")):
        text = f"é {before}{gap}{body}{gap}{after}"
        at = text.index(body)
        found = list(secrets.confirmed(text))
        assert found == [(at, at + len(body), kind)]
        assert secrets.redact(text, secrets.written(found)) == text.replace(body, "[SECRET]")


def test_hex_keys_at_any_offset():
    for key, kind in ((rsa_key(), "der"), (ssh_key(), "ssh")):
        for run in (key.hex(), key.hex().upper()):
            text = f"k abc{run} z"
            at = text.index(run)
            assert list(secrets.confirmed(text)) == [(at, at + len(run), kind)]


def test_long_runs_without_keys_are_quick_and_empty():
    for text in ("MIIE" * 200_000, "MA" * 200_000, "3082" * 200_000, "MIIEabc \\n" * 50_000, "M" * 300_000):
        assert not list(secrets.confirmed(text))
