from graphloom.operators import tokens

CODE = '''using A; // class Ghost { }
/* new Ghost() */
namespace N {
  [Tag( typeof( X ) )]
  public partial class Till<T> : Desk<List<T>, int>, IOpen, N.Other where T : class, new()
  {
    string s = "new Ghost() { " + @"a "" new Ghost()" + 'x' + '{' + """ class Raw { } """;
    string t = $"{new Coin( 1 )} {{new Ghost()}} {Bank.Instance.Name:0.0} \\" {lamp . Turn( "a" )}";
    Coin[] many = new Coin[3], one = new( 2 );
    Dictionary<string, Coin> d = new Dictionary<string, Coin>();
    void IOpen.Open() { return; }
    class Inner { void F() { new Parts.Lamp { A = 1 }; Feed.Sold += G; Feed.Sold -= G; n += 2; x?.Go(); Make().Run(); } }
    Till() : base( new Arg() ) { if ( a.B<int>( 1 ) ) return c
        .D(); HUD.Current.Score.Instance.Add(); }
    struct Small;
    int after = World.Current.Size;
  }
  record struct Rec( int A ) { void F() { new Lost(); } }
  interface IThing : IOpen { void M(); }
  class Point( int x ) : Base( x ), IEnd { Till p = new Till(); }
}
class Last { void F() { Last.F(); This.That(); } }
'''


def test_edges_of_tokens(spark):
    df = spark.createDataFrame([("a.cs", CODE), ("b.cs", None), ("c.cs", "")], "path string, text string")
    got = {(r.src, r.dst, r.kind, r.details, r.line_number) for r in tokens.csharp_edges(df).collect()}
    call = lambda src, dst, name, line: (src, dst, "MethodCall", f"Method '{name}()'", line)
    new = lambda src, dst, line: (src, dst, "Instantiates", f"new {dst}()", line)
    one = lambda src, dst, name, line: (src, dst, "SingletonAccess", f".{name}", line)
    assert got == {
        ("Till", "Desk", "Inherits", "Base Class", 5), ("Till", "IOpen", "Implements", "Interface", 5), ("Till", "N.Other", "Implements", "Interface", 5),
        new("Till", "Coin", 8), one("Till", "Bank", "Instance", 8), call("Till", "lamp", "Turn", 8), new("Till", "Dictionary<string, Coin>", 10),
        new("Inner", "Parts.Lamp", 12), ("Inner", "Feed", "EventSubscription", "Event 'Sold' +=", 12), ("Inner", "Feed", "EventSubscription", "Event 'Sold' -=", 12),
        new("Till", "Arg", 13), call("Till", "a", "B", 13), call("Till", "c", "D", 13), call("Till", "HUD.Current.Score.Instance", "Add", 14),
        one("Till", "HUD", "Current", 14), one("Till", "HUD.Current.Score", "Instance", 14), one("Till", "World", "Current", 16),
        ("IThing", "IOpen", "Implements", "Interface", 19), ("Point", "Base", "Inherits", "Base Class", 20), ("Point", "IEnd", "Implements", "Interface", 20), new("Point", "Till", 20),
        call("Last", "This", "That", 22),
    }
    order = [r.n for r in tokens.ordered_edges(df).orderBy("n").collect()]
    assert order == list(range(1, len(got) + 1))
    assert {(r.category, r.name) for r in tokens.declared_types(df).collect()} == {("Class", "Till"), ("Class", "Inner"), ("Struct", "Small"), ("Interface", "IThing"), ("Class", "Point"), ("Class", "Last")}


def test_unbalanced_and_odd_sources(spark):
    odd = ["} } class A { void F() { new B(); ", 'class A { string s = "open; new B(); }', "class A { char c = ''; } }}} class C { D d = new D(); }", "class", "new X();", "class A { /* never ends new B(); }"]
    df = spark.createDataFrame([(f"{i}.cs", t) for i, t in enumerate(odd)], "path string, text string")
    got = {(r.path, r.src, r.dst) for r in tokens.csharp_edges(df).collect()}
    assert {("0.cs", "A", "B"), ("2.cs", "C", "D")} <= got and not any(p in ("3.cs", "4.cs") for p, _, _ in got)


def test_no_python_reads_the_sources(spark):
    df = spark.createDataFrame([("a.cs", CODE)], "path string, text string")
    plan = tokens.csharp_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sources_are_read_once_and_few_tokens_are_rows(spark):
    rows = spark.range(300).selectExpr("concat(id, '.cs') path", r"concat('class A', id, ' : B { int a = 1, b = 2;\n // c\n void F( int n, int m ) { p.Go( n + m ); } }') text")
    plan = tokens.csharp_edges(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1  # each kind of edge read the sources by itself
    assert tokens.owned_rows(rows).count() == 300 * 6  # a declaration, four braces, a call
    assert {(r.line, r.name, r.owner) for r in tokens.owned_rows(rows).where("path = '7.cs'").collect()} == {(1, "A7", "A7"), (1, None, "A7"), (3, None, "A7")}
    assert tokens.csharp_edges(rows).count() == 600
