"""Generated cases in formats that the operators' own training examples don't have."""

import random
import string

B62 = string.ascii_letters + string.digits
HEX = "0123456789abcdef"


def secret_cases(seed=21, times=12):
    """(name, text, path, value, label)."""
    r = random.Random(seed)
    s = lambda a, k: "".join(r.choice(a) for _ in range(k))
    w = lambda: r.choice(["server", "update", "the", "monthly", "report", "was", "sent", "before", "lunch", "and", "nobody", "noticed", "until", "friday"])
    word = lambda: r.choice(["getUser", "loadConfig", "parseHeader", "buildTree", "renderPage", "fetchRows", "openWindow"])
    yes = {
        "gitlab": lambda: ("GITLAB_TOKEN=glpat-{}", s(B62, 20), "glpat-{}"),
        "env": lambda: ("export STRIPE_SECRET={}", s(B62, 32), "{}"),
        "url": lambda: ("db_password: {}", s(B62 + "#$", 16), "{}"),
        "azure": lambda: ("SharedAccessKey={}=", s(B62 + "+/", 43), "{}="),
        "json": lambda: ('{{"client_secret": "{}"}}', s(B62 + "-_", 34), "{}"),
        "yaml": lambda: ("  api-key: {}", s(HEX, 48), "{}"),
        "npm": lambda: ("//registry/:_authToken=npm_{}", s(B62, 36), "npm_{}"),
        "header": lambda: ("X-Auth-Token: {}", s(HEX, 32), "{}"),
        "ruby": lambda: ("secret_key_base => '{}'", s(HEX, 128), "{}"),
        "ec key": lambda: ("-----BEGIN EC PRIVATE KEY-----\n{}\n-----END EC PRIVATE KEY-----", s(B62 + "+/", 164), "-----BEGIN EC PRIVATE KEY-----\n{}\n-----END EC PRIVATE KEY-----"),
        "google": lambda: ('"key": "AIza{}"', s(B62, 35), "AIza{}"),
    }
    no = {
        "git log": lambda: (f"commit {s(HEX, 40)} by {w()}", ""),
        "docker": lambda: (f"image sha256:{s(HEX, 64)} pulled", ""),
        "trace": lambda: (f"trace_id {s(HEX, 8)}-{s(HEX, 4)}-{s(HEX, 4)}-{s(HEX, 4)}-{s(HEX, 12)}", ""),
        "code": lambda: (f"token = {word()}.{word()}()", ""),
        "code 2": lambda: (f"password = self.{word()}Field.text", ""),
        "slug": lambda: (f"https://site/{w()}-{w()}-{w()}-{w()}-{r.randint(100, 9999)}", ""),
        "digits": lambda: (f"parcel {s('0123456789', 20)}", ""),
        "doc": lambda: ("api_key: YOUR-API-KEY-GOES-HERE-1", ""),
        "prose": lambda: (f"the secret: {w()} {w()} and the key: everything", ""),
        "snake": lambda: (f"max_{w()}_{w()}_{w()}_{w()}_v2", ""),
        "color": lambda: (f"md5 checksum {s(HEX, 32)} of build", ""),
    }
    out = []
    for _ in range(times):
        for name, make in yes.items():
            template, x, value = make()
            out.append((name, f"{w()} {w()}\n{template.format(x)}\n{w()}", r.choice(["src2", "app/main"]), value.format(x), 1))
        for name, make in no.items():
            out.append((name, f"{w()} {w()} {make()[0]} {w()}", r.choice(["src2", "app/main"]), "", 0))
    return out


def pii_cases(seed=31, times=12):
    """(name, text, kind, value): personal data that the strict patterns don't have whole, and (kind None) what looks alike."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    who = lambda: r.choice(["marta", "li.wei", "o_brien", "jonas77", "k.adams", "priya"])
    host = lambda: r.choice(["mailhost", "uni-bonn", "acme", "post", "club99"])
    w = lambda: r.choice(["please", "reply", "soon", "the", "committee", "about", "budget", "thanks", "later", "garden"])

    def card(k):
        s = r.choice("345") + n(k - 2)
        t = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(s))))
        return s + str(-t % 10)

    yes = {
        "at org": ("email", lambda: f"{who()} {{at}} {host()} {{dot}} org"),
        "AT": ("email", lambda: f"{who()} [AT] {host()}.edu"),
        "words": ("email", lambda: f"{who()} at {host()} dot ac dot uk"),
        "accent": ("email", lambda: f"andré.{who()}@{host()}.fr"),
        "v6": ("ip", lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8))),
        "v6 short": ("ip", lambda: f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(1, 65536):x}"),
        "defanged": ("ip", lambda: f"{r.randint(1, 255)}(.){r.randint(1, 255)}(.){r.randint(1, 255)}(.){r.randint(1, 255)}"),
        "card slash": ("card", lambda: "/".join([(c := card(16))[:4], c[4:8], c[8:12], c[12:]])),
        "amex": ("card", lambda: f"{(c := card(15))[:4]} {c[4:10]} {c[10:]}"),
        "us": ("phone", lambda: f"({n(3)}) {n(3)}-{n(4)}"),
        "de": ("phone", lambda: f"0{n(3)}/{n(3)} {n(3)}"),
        "bare": ("phone", lambda: f"0{n(9)}"),
    }
    lead = {"email": ["write to", "mail", "contact", "address"], "ip": ["from host", "server", "ip"], "card": ["credit card", "visa", "card no"], "phone": ["tel.", "phone", "call me on", "my mobile:"]}
    no = {
        "iso": lambda: f"on 20{n(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} at 1{r.randint(0, 9)}:3{r.randint(0, 9)}",
        "amounts": lambda: f"total {n(3)} {n(3)} {n(2)} euro",
        "isbn": lambda: f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        "order": lambda: f"order {n(3)}-{n(7)}-{n(7)}",
        "version": lambda: f"version {n(2)}.{n(2)}.{n(4)}.{n(2)}",
        "time": lambda: f"{r.randint(10, 23)}:{n(2)}:{n(2)} and {r.randint(10, 23)}:{n(2)}",
        "place": lambda: f"dinner at {w()}.It was fine",
        "score": lambda: f"score {n(2)}-{n(2)}, {n(2)}-{n(2)}",
        "sku": lambda: f"sku {n(4)}-{n(4)}-{n(2)}",
        "serial": lambda: f"serial {n(13)}",
    }
    out = []
    for _ in range(times):
        for name, (kind, make) in yes.items():
            value = make()
            out.append((name, f"{w()} {w()} {r.choice(lead[kind])} {value} {w()}", kind, value))
        for name, make in no.items():
            out.append((name, f"{w()} {w()} {make()} {w()}", None, ""))
    return out
