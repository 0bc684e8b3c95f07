"""Source files in ten languages, and by hand what definitions they hold.

``_KEY_`` stands for the key of a row of ``part``, so that every row gives a file.
Each definition is written as (name, type, class, first line, last line, first
column, header): the text is that of the lines from the column on, or the header.
"""

from __future__ import annotations

from dataclasses import dataclass

KEY = "_KEY_"
UNSUPPORTED = "MOVE A TO _KEY_.\n"


@dataclass(frozen=True)
class Sample:
    extension: str
    language: str
    text: str
    definitions: tuple[tuple, ...]

    def content(self, definition: tuple) -> str:
        _, _, _, first, last, column, header = definition
        return header or "\n".join(self.text.split("\n")[first - 1 : last])[column:]


SAMPLES = (
    Sample(
        ".py",
        "python",
        '''import os  # class Nope:

TEXT = """
class Hidden_KEY_:
    def not_me(self): pass
"""

@decorated(
    name="x:y",
)
class Part_KEY_(Base,
              metaclass=Meta):  # header
    label: str = "def no(): {"

    @property
    async def first(
        self, x: dict = {"a": 1},
    ) -> "list[int]":
        def inner():
            return 1

        return inner()

    class Deep_KEY_:
        def last(self): return 2


if os.name:
    def make__KEY_(x): \\
        return Part_KEY_()
''',
        (
            ("Part_KEY_", "class", None, 11, 25, 0, "class Part_KEY_(Base,\n              metaclass=Meta):"),
            ("first", "method", "Part_KEY_", 16, 22, 4, None),
            ("Deep_KEY_", "class", "Part_KEY_", 24, 25, 4, "class Deep_KEY_:"),
            ("last", "method", "Deep_KEY_", 25, 25, 8, None),
            ("make__KEY_", "function", None, 29, 30, 4, None),
        ),
    ),
    Sample(
        ".go",
        "go",
        """package parts

import "fmt"

var table = map[string]int{"{": _KEY_}

type ID_KEY_ int

type Part_KEY_ struct {
\tName string `json:"}"`
\tsub  struct{ x int }
}

func (p *Part_KEY_) Step(
\tn int,
\tf func(int) interface{},
) (int, error) {
\tinner := func() { fmt.Println("}") }
\tinner()
\treturn n, nil // }
}

func Make_KEY_() map[string]interface{} {
\treturn map[string]interface{}{"a": struct{}{}}
}
""",
        (
            ("ID_KEY_", "type", None, 7, 7, 0, None),
            ("Part_KEY_", "type", None, 9, 12, 0, None),
            ("Step", "method", "Part_KEY_", 14, 21, 0, None),
            ("Make_KEY_", "function", None, 23, 25, 0, None),
        ),
    ),
    Sample(
        ".js",
        "javascript",
        """import x from "y"
const rule = /[{}]/g, text = `class No { ${a} }`

export default class Part_KEY_
  extends Base {
  size = 3
  static async step(a, b = {}) {
    function inner() { return a }
    return inner()
  }
  get name() { return "}" }
  arrow = () => { return 1 }
}

const tools = {
  run(a) { if (a) { return 1 } },
  plain: 2,
}
export async function make_KEY_(x,
  y) {
  for (;;) { break }
}
""",
        (
            ("Part_KEY_", "class", None, 4, 13, 15, "class Part_KEY_\n  extends Base"),
            ("step", "method", "Part_KEY_", 7, 10, 2, None),
            ("name", "method", "Part_KEY_", 11, 11, 2, None),
            ("run", "method", None, 16, 16, 2, "run(a) { if (a) { return 1 } }"),
            ("make_KEY_", "function", None, 19, 22, 7, None),
        ),
    ),
    Sample(
        ".ts",
        "typescript",
        """@Injectable({ providedIn: "root" })
export class Part_KEY_<T extends object> implements Shape {
  constructor(private readonly a: string) { super() }

  @Input() name: string = "x";

  @Memo()
  public async step<K extends keyof T>(
    key: K,
    rest: { a: number; b: string },
  ): Promise<{ ok: boolean }> {
    const f = (x: number): number => { return x };
    return { ok: true };
  }
  abstract later(): void;
}

interface Shape_KEY_ {
  area(): number;
}

function make_KEY_(x: Map<string, number>): Part_KEY_<{}> {
  return new Part_KEY_("");
}
""",
        (
            ("Part_KEY_", "class", None, 2, 16, 7, "class Part_KEY_<T extends object> implements Shape"),
            ("constructor", "method", "Part_KEY_", 3, 3, 2, None),
            ("step", "method", "Part_KEY_", 8, 14, 2, None),
            ("Shape_KEY_", "interface", None, 18, 20, 0, "interface Shape_KEY_"),
            ("make_KEY_", "function", None, 22, 24, 0, None),
        ),
    ),
    Sample(
        ".tsx",
        "tsx",
        """export function View_KEY_({ name }: Props) {
  return <div className="a">{name}</div>;
}

class Panel_KEY_ extends React.Component<Props> {
  render() {
    return <View_KEY_ name={"}"} />;
  }
}
""",
        (
            ("View_KEY_", "function", None, 1, 3, 7, None),
            ("Panel_KEY_", "class", None, 5, 9, 0, "class Panel_KEY_ extends React.Component<Props>"),
            ("render", "method", "Panel_KEY_", 6, 8, 2, None),
        ),
    ),
    Sample(
        ".java",
        "java",
        '''package parts;

/* class No { */
@Entity(name = "part{")
public final class Part_KEY_<T extends Comparable<T>>
        extends Base implements Shape {
    private int[] sizes = {1, 2};

    public Part_KEY_(int a) {
        this.a = a;
    }

    @Override
    @SuppressWarnings({"unchecked", "raw"})
    public <R> Map<String, List<R>> step(int n,
            @Nullable String s) throws IOException {
        Runnable r = () -> { run(); };
        Object o = new Object() { public void no() { } };
        return null;
    }

    abstract int later(String s);

    static class Deep_KEY_ {
        String text() { return """
            }
            """; }
    }

    enum Kind { A(1), B(2) { int f() { return 3; } }; Kind(int x) { } }
}

interface Shape_KEY_ {
    int area();
    default int twice() { return 2 * area(); }
}
''',
        (
            (
                "Part_KEY_", "class", None, 4, 31, 0,
                '@Entity(name = "part{")\npublic final class Part_KEY_<T extends Comparable<T>>\n'
                "        extends Base implements Shape",
            ),
            ("Part_KEY_", "method", "Part_KEY_", 9, 11, 4, None),
            ("step", "method", "Part_KEY_", 13, 20, 4, None),
            ("later", "method", "Part_KEY_", 22, 22, 4, None),
            ("Deep_KEY_", "class", "Part_KEY_", 24, 28, 4, "static class Deep_KEY_"),
            ("text", "method", "Deep_KEY_", 25, 27, 8, None),
            ("f", "method", "Part_KEY_", 30, 30, 29, "int f() { return 3; }"),
            ("Kind", "method", "Part_KEY_", 30, 30, 54, "Kind(int x) { }"),
            ("Shape_KEY_", "interface", None, 33, 36, 0, "interface Shape_KEY_"),
            ("area", "method", "Shape_KEY_", 34, 34, 4, None),
            ("twice", "method", "Shape_KEY_", 35, 35, 4, None),
        ),
    ),
    Sample(
        ".rs",
        "rust",
        """use std::fmt;

#[derive(Debug)]
pub struct Part_KEY_<'a, T: Clone> {
    name: &'a str,
    text: T,
}
struct Unit_KEY_;
struct Pair_KEY_(i32, i32);

pub enum Kind_KEY_ {
    A { x: i32 },
    B,
}

pub trait Shape_KEY_ {
    fn area(&self) -> i32;
    fn twice(&self) -> i32 { 2 * self.area() }
}

impl<'a, T: Clone> Part_KEY_<'a, T> {
    #[inline]
    pub(crate) async fn step<F>(
        &self,
        f: F,
    ) -> Result<(), ()>
    where
        F: Fn(char) -> bool,
    {
        fn inner() {}
        match f('{') { true => Ok(()), _ => Err(()) }
    }
}

impl fmt::Display for Unit_KEY_ {
    fn fmt(&self) -> i32 { r#"}"#.len() as i32 }
}

macro_rules! make { ($x:ident) => { fn no() {} }; }

mod inside {
    pub unsafe extern "C" fn make__KEY_() {}
}
""",
        (
            ("Part_KEY_", "struct", None, 4, 7, 0, "pub struct Part_KEY_<'a, T: Clone>"),
            ("Unit_KEY_", "struct", None, 8, 8, 0, None),
            ("Pair_KEY_", "struct", None, 9, 9, 0, None),
            ("Kind_KEY_", "enum", None, 11, 14, 0, None),
            ("Shape_KEY_", "trait", None, 16, 19, 0, "pub trait Shape_KEY_"),
            ("twice", "method", "Shape_KEY_", 18, 18, 4, None),
            ("step", "method", "Part_KEY_", 23, 32, 4, None),
            ("fmt", "method", "Unit_KEY_", 36, 36, 4, None),
            ("make__KEY_", "function", None, 42, 42, 4, None),
        ),
    ),
    Sample(
        ".c",
        "c",
        """#include <stdio.h>
#define OPEN(x) { \\
    x }

typedef struct node__KEY_ {
    int v; /* } */
    struct { int a; } inner;
} node_t;

static const char *names[] = { "{", "b" };
int declared(struct node__KEY_ *n);

static struct node__KEY_ *
make__KEY_(int a,
         int (*f)(int))
{
    struct node__KEY_ n = { .v = 1 };
    if (a) { return 0; }
    return f('{');
}
""",
        (
            ("node__KEY_", "struct", None, 5, 8, 8, "struct node__KEY_"),
            ("make__KEY_", "function", None, 13, 20, 0, None),
        ),
    ),
    Sample(
        ".cpp",
        "cpp",
        """#include <string>
namespace parts {

template <typename T, class U = std::pair<int, T>>
class Part_KEY_ final : public Base<T>, private Other {
public:
    Part_KEY_(int a) : a_{a}, b_(a) { init(); }
    ~Part_KEY_() = default;
    std::string name() const override { return R"(})"; }
    template <class V> static V make(V v) {
        struct Local { int x; };
        return v;
    }
    int declared() const;
    bool operator==(const Part_KEY_ &o) const { return true; }
private:
    enum class Kind { A, B };
    int a_{0};
};

struct Plain_KEY_ { int x = 0; };

template <class T>
int Part_KEY_<T>::declared() const
{
    return [this] { return a_; }();
}

std::vector<std::string> run__KEY_(const std::map<int, int> &m) noexcept {
    return {};
}

}  // namespace
""",
        (
            (
                "Part_KEY_", "class", None, 5, 19, 0,
                "class Part_KEY_ final : public Base<T>, private Other",
            ),
            ("Part_KEY_", "method", "Part_KEY_", 7, 7, 4, None),
            ("name", "method", "Part_KEY_", 9, 9, 4, None),
            ("make", "method", "Part_KEY_", 10, 13, 23, None),
            (None, "method", "Part_KEY_", 15, 15, 4, None),
            ("Plain_KEY_", "struct", None, 21, 21, 0, "struct Plain_KEY_"),
            (None, "function", None, 24, 27, 0, None),
            ("run__KEY_", "function", None, 29, 31, 0, None),
        ),
    ),
    Sample(
        ".rb",
        "ruby",
        """require "x" # class No

=begin
class Hidden
=end
module Parts
  class Part_KEY_ < Base
    attr_reader :name

    def step(a,
             b = "end")
      if a
        b
      end
    end

    def ==(other) = name == other.name

    def self.build
      new
    end

    def empty?; true; end
  end
end
""",
        (
            ("Part_KEY_", "class", None, 7, 24, 2, "class Part_KEY_ < Base"),
            ("step", "method", "Part_KEY_", 10, 15, 4, None),
            ("==", "method", "Part_KEY_", 17, 17, 4, None),
            ("empty?", "method", "Part_KEY_", 23, 23, 4, None),
        ),
    ),
)
