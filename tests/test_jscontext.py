import pytest

from ferrule.functions.jscontext import Script, contexts
from ferrule.functions.jsparse import parse


def one(code, path):
    return contexts(code, [path])[0][1:]


def test_function_and_callers():
    found, wrapper, callers = one('function getUser(id){ return http.get("/api/user/" + id); } function page(){ getUser(7); }', "/api/user/")
    assert found and wrapper == 'function getUser(id){ return http.get("/api/user/" + id); }' and callers == ["function page(){ getUser(7); }"]


def test_constants_are_filled_in():
    assert one('const P={u:"/api/u"}; function g(){ return q(P.u, "/api/x"); }', "/api/x")[1] == 'function g(){ return q("/api/u", "/api/x"); }'
    assert one('var a=["/p","/q"], b="x"; function g(){ return q(a[1], b + "z", a["k"], "/api/x"); }', "/api/x")[1] == 'function g(){ return q("/q", "x" + "z", a["k"], "/api/x"); }'


def test_templates_dont_count_and_first_path_wins():
    assert one("f(`/api/t`)", "/api/t") == (False, "", [])
    assert [c[1] for c in contexts('f("/api/user/list")', ["/api/user", "/api/user/list"])] == [True, False]


def test_statement_with_its_declarations():
    assert one('var b="/api/user";', "/api/user")[1] == '\nb="/api/user"'
    assert one('var h = mk(); go(h , "/api/y");', "/api/y")[1] == 'var h = mk();\ngo(h , "/api/y");'
    assert one('var h = mk(), u = h + "/api/y";', "/api/y")[1] == 'var h = mk();\nu = h + "/api/y"'


def test_self_reference_ends():
    assert one('var a = a + "x"; f(a, "/api/z");', "/api/z")[0]


@pytest.mark.parametrize("code", ["", "(", "}{", "function", "a ? b", "`${`${x}`", "for(;;", "class A { x = 1; get y(){return 1} static async *z(){} }", "x => y => ({a, ...b, [c]: 1, d(){}})", "var r = /[/]\\//g.test(s) / 2;", "new new A()()", "new.target", "a?.b?.[c]?.(d)", "label: for (const [k, v] of m) { continue label }", "import x, {y} from 'z'\nexport default function(){}", "switch(a){case 1: b(); default: c()}", "try{}catch{}finally{}", "\\", "a = function*(){ yield* b; }", "<div>", "if(a)b;else c", "do x(); while(y)", "0x1F + 1e5 + .5", "'unclosed\nnext()"])
def test_any_text_gives_a_tree(code):
    root = parse(code)
    for n in root.walk():
        assert 0 <= n.start <= n.end <= len(code)
        assert n is root or (n.parent is not None and n in n.parent.children)


def test_calls_in_every_place():
    s = Script("a(); x = {m(){ b() }, n: () => c()}; `${d()}`; if (e()) { for (f();g();h()) i() } class Q { r = j(); s(){ k() } } let t = async (u = l()) => { await m() }")
    names = sorted(s.text(n.fields["function"]) for n in s.root.walk() if n.type == "call_expression")
    assert names == sorted("abcdefghijklm")


def test_deep_code_is_not_fatal():
    assert contexts("(" * 50_000 + '"/api/x"', ["/api/x"])[0][1] in (True, False)
    assert one("f(" + " + ".join(f'"{i}"' for i in range(5000)) + ' + "/api/x")', "/api/x")[0]
