"""A few source files with real structure, and what their chunks are by the chunking rules.

Expected chunks that are whole lines of a file are told by their lines, and SQL cuts them out;
only those that are put together (summaries, chunks with a comment in front) are told as text.
"""

from __future__ import annotations

FILES = {
    "shop/Cart.cs": """using System;
namespace Shop
{
    public interface ICart
    {
        int Count { get; }
        void Add(string item);
    }

    public record Item(string Name, int Price);

    public enum Kind { A, B }

    public class CartController
    {
        private int total;
        public int Total { get; set; }

        public CartController(int start)
        {
            total = start;
        }

        public void Login(string token)
        {
            if (token == null) { throw new Exception("{"); }
            total += 1;
        }
    }
}
""",
    "shop/Shape.Designer.cs": "class Shape { }\n",
    "shop/cart.c": """#include <stdio.h>
#define LIMIT 10
typedef unsigned int uint;
struct point
{
    int x;
    int y;
};
enum color { RED, GREEN };

static int add(int a, int b)
{
    return a + b;
}

void login(struct point *p)
{
    if (p) { add(p->x, p->y); }
}
""",
    "shop/Cart.razor": """@page "/cart"
@inject CartService Cart

<h1>Cart</h1>
<p>Total of all that lies in the cart, with taxes and without the voucher: @Cart.Total</p>
<p>Go on to the <a href="/checkout">checkout</a>.</p>

@code {
    private int n;

    private void Add()
    {
        n++;
    }
}
""",
}

_ICART = "    public interface ICart\n{\n    int Count { get; }\n    void Add(string item);\n}"
_CLASS = "using System;\nnamespace Shop\n    public class CartController\n{\n    private int total;\n    public int Total;\n    public CartController(int start);\n    public void Login(string token);\n}"
_METHOD = '// In class CartController\npublic void Login(string token)\n        {\n            if (token == null) { throw new Exception("{"); }\n            total += 1;\n        }'

#: (file, first line, last line, type, text if it isn't just those lines)
CHUNKS = [
    ("shop/Cart.cs", 4, 8, "interface", _ICART),
    ("shop/Cart.cs", 10, 10, "record", None),
    ("shop/Cart.cs", 12, 12, "enum", None),
    ("shop/Cart.cs", 14, 29, "class-auth", _CLASS),
    ("shop/Cart.cs", 17, 17, "property", "// In class CartController\n        public int Total { get; set; }"),
    ("shop/Cart.cs", 24, 28, "method-auth", _METHOD),
    ("shop/Shape.Designer.cs", 1, 1, "class", "class Shape\n{\n    // Members...\n}"),
    ("shop/Shape.Designer.cs", 1, 2, "generated", "class Shape { }\n"),
    ("shop/cart.c", 2, 2, "c-macro", None),
    ("shop/cart.c", 3, 3, "c-typedef", None),
    ("shop/cart.c", 4, 8, "c-struct", None),
    ("shop/cart.c", 9, 9, "c-enum", None),
    ("shop/cart.c", 11, 14, "c-function", None),
    ("shop/cart.c", 16, 19, "c-function-auth", None),
    ("shop/Cart.razor", 4, 6, "razor-html", None),
    ("shop/Cart.razor", 8, 15, "razor-code", None),
]


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql() -> str:
    """The expected chunks of all files."""
    files = ", ".join(f"({_literal(p)}, {_literal(t)})" for p, t in FILES.items())
    chunks = ", ".join(f"({_literal(p)}, {a}, {b}, {_literal(kind)}, {_literal(text)})" for p, a, b, kind, text in CHUNKS)
    return f"""WITH f(path, text) AS (VALUES {files}), c(path, a, b, kind, text) AS (VALUES {chunks})
SELECT c.path AS file_path, a::INT AS start_line, b::INT AS end_line, kind AS chunk_type, coalesce(c.text, array_to_string(string_split(f.text, chr(10))[a:b], chr(10))) AS content FROM c JOIN f USING (path)"""
