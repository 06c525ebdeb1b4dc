"""Form templates planted into pages, and the scan that reads forms back out of HTML."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.tables import spread, table

EVERY = 17
# (k, action, text inside the form, text of a timer element, [(tag, type, name, autocomplete, placeholder, style, outer style, class, value, label)])
TEMPLATES = [
    (0, "/pay", "Pay here", "", [("input", "text", "card_number", "cc-number", "", "", "", "", "4111 1111 1111 1111", "Card"),
                                 ("input", "text", "cvv", "", "CVV", "", "", "", "452", "Code")]),
    (1, "https://collect.example.net/x", "Verify", "", [("input", "text", "username", "", "", "", "", "", "olena", "Name"),
                                                        ("input", "text", "cardNumber", "cc-number", "", "opacity:0.01", "", "", "", "")]),
    (2, "https://pay.example.net/go", "Checkout", "", [("input", "text", "cc-exp", "cc-exp", "MM/YY", "", "", "", "08/28", "Expiry")]),
    (3, "#", "Order expires soon", "04:59", [("input", "email", "email", "", "", "", "", "", "", "Mail")]),
    (4, "https://", "Broken", "", [("input", "password", "pass", "", "", "", "", "", "Qwerty2026", "Password")]),
    (5, "/id", "Анкета", "", [("input", "text", "maiden", "", "дівоче прізвище матері", "", "", "", "", "Прізвище"),
                              ("input", "text", "dob", "", "", "", "", "", "", "дата народження")]),
    (6, "/tax", "Дані", "", [("input", "text", "taxId", "", "", "", "", "", "{value}", "ІПН"),
                             ("input", "text", "passportNumber", "", "номер паспорта", "", "", "", "", "")]),
    (7, "/s", "Search", "", [("input", "search", "q", "", "", "", "", "", "", ""), ("input", "hidden", "csrf_token", "", "", "", "", "", "abc", "")]),
    (8, "//auth.{site}/login", "Login", "", [("input", "password", "password", "current-password", "", "", "left:-9999px;position:absolute", "", "", "")]),
    (9, "https://stripe.com/v1", "Pay", "", [("input", "text", "cvc", "cc-csc", "", "width:1px;height:1px;overflow:hidden", "", "", "", ""),
                                             ("select", "select", "exp_month", "cc-exp-month", "", "", "", "", "", "Month")]),
    (10, "/w", "Терміново підтвердіть виплату, залишилось 10 хвилин", "", [("textarea", "text", "note", "", "", "", "", "sr-only", "code cvv 123", "Note"),
                                                                          ("input", "text", "pin", "", "PIN", "transform:scale(0)", "", "", "", "")]),
    (11, "https://evil.example.com/p", "Отримати кошти", "", [("input", "text", "amount", "", "", "", "", "", "1500", "Сума"),
                                                             ("input", "text", "pan", "", "", "", "display:none", "", "5500005555555559", "Картка"),
                                                             ("input", "hidden", "cvv2", "", "", "", "", "", "777", "")]),
]
FIELD_COLUMNS = "k, action, form_text, timer_text, field_no, tag, type, name, autocomplete, placeholder, style, outer_style, class, value, label"


def field_rows() -> list[tuple]:
    return [(k, a, t, tm, i, *f) for k, a, t, tm, fields in TEMPLATES for i, f in enumerate(fields)]


def render(template: tuple) -> str:
    _, action, text, timer, fields = template
    q = lambda s: escape(s, quote=True)
    out = [f'<form action="{q(action)}"><p>{q(text)}</p>']
    if timer:
        out.append(f'<span class="countdown">{q(timer)}</span>')
    for tag, typ, name, auto, hint, style, outer, cls, value, label in fields:
        attrs = f'name="{q(name)}" id="{q(name)}" autocomplete="{q(auto)}" placeholder="{q(hint)}" style="{q(style)}" class="{q(cls)}"'
        body = {"input": f'<input type="{typ}" {attrs} value="{q(value)}">', "textarea": f"<textarea {attrs}>{q(value)}</textarea>",
                "select": f"<select {attrs}><option>1</option></select>"}[tag]
        out.append(f'<div style="{q(outer)}"><label for="{q(name)}">{q(label)}</label>{body}</div>')
    return "".join(out) + "</form>"


def planted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a form from the template list in front of the closing body tag."""
    forms = spark.createDataFrame([(t[0], render(t)) for t in TEMPLATES], "k long, form string")
    pages = spread(table(spark, folder, "pages"), "page_id").withColumn("k", F.col("page_id") % EVERY)
    # A dozen fixed rows, hence safe to broadcast.
    j = pages.join(F.broadcast(forms), "k", "left")
    site = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    value = (F.lit(3000000000) + (F.col("page_id") * 7919) % 999999937).cast("string")
    form = F.replace(F.replace("form", F.lit("{site}"), site), F.lit("{value}"), value)
    html = F.when(F.col("form").isNotNull(), F.replace("html", F.lit("</body>"), F.concat(form, F.lit("</body>")))).otherwise(F.col("html"))
    return j.select("page_id", "url", html.alias("html"))


FORM_SCHEMA = (
    "page_id long, url string, form_no int, action string, form_text string, timer_text string, fields array<struct<"
    "field_no:int,tag:string,type:string,name:string,id:string,autocomplete:string,placeholder:string,aria_label:string,"
    "style:string,outer_style:string,class:string,value:string,label:string>>"
)
_VOID = {"input", "br", "img", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
_TIMER = ("timer", "countdown", "counter", "clock", "expire")


class _FormReader(HTMLParser):
    """Walks one page and keeps what lies inside its forms, with the styles of the enclosing elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.forms, self.open, self.form, self.label, self.area = [], [], None, None, None
        self.labels: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.form = {"action": a.get("action", ""), "text": [], "timer": [], "fields": []}
            self.forms.append(self.form)
        if tag == "label":
            self.label = a.get("for", "")
        if tag in ("input", "textarea", "select") and self.form is not None:
            outer = ";".join(s for _, s, _ in self.open if s)
            field = {k: a.get(k, "") for k in ("name", "id", "autocomplete", "placeholder", "style", "class", "value")}
            field.update(tag=tag, type=a.get("type", "select" if tag == "select" else "text"), aria_label=a.get("aria-label", ""), outer_style=outer)
            self.form["fields"].append(field)
            self.area = field if tag == "textarea" else None
        if tag not in _VOID:
            marks = (a.get("class", "") + " " + a.get("id", "")).lower()
            self.open.append((tag, a.get("style", ""), any(t in marks for t in _TIMER)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag == "form":
            self.form = None
        elif tag == "label":
            self.label = None
        elif tag == "textarea":
            self.area = None

    def handle_data(self, data):
        if self.area is not None:
            self.area["value"] += data
        elif self.form is not None:
            self.form["text"].append(data)
            if any(t for _, _, t in self.open):
                self.form["timer"].append(data)
        if self.label:
            self.labels[self.label] = self.labels.get(self.label, "") + data


def extract_forms(pages: DataFrame) -> DataFrame:
    """One row per form with its fields; nesting needs a parser, so this is the one place that reads HTML in Python."""
    import pandas as pd

    def read(batches):
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                reader = _FormReader()
                reader.feed(html)
                for n, f in enumerate(reader.forms):
                    fields = [
                        {"field_no": i, **{k: x[k] for k in ("tag", "type", "name", "id", "autocomplete", "placeholder", "aria_label", "style", "outer_style", "class", "value")},
                         "label": reader.labels.get(x["id"], "")}
                        for i, x in enumerate(f["fields"])
                    ]
                    text = " ".join(" ".join(f["text"]).split())
                    rows.append((page_id, url, n, f["action"], text, " ".join(f["timer"]).strip(), fields))
            yield pd.DataFrame(rows, columns=["page_id", "url", "form_no", "action", "form_text", "timer_text", "fields"])

    with_form = pages.filter(F.lower("html").contains("<form"))  # other pages, and null ones, never leave the JVM
    return with_form.select("page_id", "url", "html").mapInPandas(read, FORM_SCHEMA)
